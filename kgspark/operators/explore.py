"""Searches, descriptions, facets and statistics over the triple table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import local_name
from kgspark.model import LABEL, NS, SAME_AS, SCHEMA, SEE_ALSO, TYPE, Namespaces, edges, instances, likely

#: Link types by a part of their address, in the order they are tried.
HOSTS = ("fandom", "dbpedia", "wikidata", "yago", "wikipedia")


def count_triples(graph: DataFrame) -> DataFrame:
    return graph.agg(F.count("*").alias("n"))


def type_statistics(graph: DataFrame) -> DataFrame:
    """(type, n): entities per type by local name, and their total; of types that share a local name the smaller count stays."""
    counts = edges(graph, TYPE, o="cls").groupBy("cls").agg(F.count_distinct("s").alias("n"))
    own = counts.groupBy(local_name(F.col("cls")).alias("type")).agg(F.min("n").alias("n"))
    return own.unionByName(count_triples(graph).select(F.lit("total").alias("type"), "n"))


def home_statistics(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """One row: triples, and entities of the four main classes, in one pass."""
    of = lambda cls: F.count_if((F.col("p") == TYPE) & (F.col("o") == cls))
    return graph.agg(
        F.count("*").alias("triples"), of(ns.ont + "Character").alias("characters"), of(ns.ont + "Location").alias("locations"),
        of(ns.ont + "Artifact").alias("artifacts"), of(SCHEMA + "Event").alias("events"),
    )


def search_label(graph: DataFrame, term: str, cls: str | None = None, limit: int = 50, labels: DataFrame | None = None) -> DataFrame:
    """(s, label, type): labels that contain a term in any case, with each type; the filter runs on labels alone.

    ``labels``, here and below: label triples that an index found for the term, in place of all labels.
    """
    found = edges(graph if labels is None else labels, LABEL, o="label").filter(F.lower("label").contains(term.lower()))
    types = edges(graph, TYPE, o="type")
    out = found.join(types, "s", "left") if cls is None else found.join(types.filter(F.col("type") == cls), "s")
    return out.distinct().orderBy("s", "label", "type").limit(limit)


def bucket(cls: Column, ns: Namespaces = NS) -> Column:
    """The search bucket of a class; null for classes that are not searched."""
    return (
        F.when(cls.isin(ns.ont + "Character", SCHEMA + "Person"), "character")
        .when(cls.isin(ns.ont + "Location", SCHEMA + "Place"), "location")
        .when(cls.isin(ns.ont + "Artifact"), "artifact")
        .when(cls.isin(SCHEMA + "Event", ns.ont + "Battle", ns.ont + "War"), "event")
        .when(cls.isin(SCHEMA + "Thing", SCHEMA + "Book"), "other")
    )


def search_entities(graph: DataFrame, term: str, wanted: str | None = None, limit: int = 50, ns: Namespaces = NS, labels: DataFrame | None = None) -> DataFrame:
    """(s, label, bucket): one row per matching entity of a known type; of several buckets the first by precedence."""
    order = F.array(*[F.lit(x) for x in ("character", "location", "artifact", "event", "other")])
    found = edges(graph if labels is None else labels, LABEL, o="label").filter(F.lower("label").contains(term.lower()))
    types = edges(graph, TYPE, o="type").withColumn("bucket", bucket(F.col("type"), ns)).filter("bucket IS NOT NULL")
    rows = found.join(types, "s").groupBy("s").agg(F.min("label").alias("label"), F.min(F.array_position(order, F.col("bucket"))).alias("b"))
    rows = rows.select("s", "label", F.element_at(order, F.col("b").cast("int")).alias("bucket"))
    return (rows if wanted is None else rows.filter(F.col("bucket") == wanted)).orderBy("s").limit(limit)


def entity_links(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """(s, link_type, uri): one link per host, and flags card and csv where an entity has such data."""
    uri = F.col("o")
    kind = F.when(uri.startswith(ns.wiki), None)
    for host in HOSTS:
        kind = kind.when(uri.contains(host), host)
    links = graph.filter(F.col("p").isin(SAME_AS, SEE_ALSO)).select("s", kind.alias("link_type"), uri.alias("uri")).filter("link_type IS NOT NULL")
    links = links.groupBy("s", "link_type").agg(F.min("uri").alias("uri"))
    flags = F.when(F.col("p") == ns.prop + "card", "card").when(F.col("p").isin(ns.prop + "hairColor", ns.prop + "height"), "csv")
    own = graph.select("s", flags.alias("link_type")).filter("link_type IS NOT NULL").distinct()
    return links.unionByName(own.withColumn("uri", F.lit(None).cast("string")))


def facet_entities(graph: DataFrame, classes: list[str], sources: list[str], most: int = 50, pick: int | None = None, seed: int = 0, ns: Namespaces = NS) -> DataFrame:
    """(s, type, label): labelled entities of the classes that have all the sources; up to ``most`` per class, then ``pick`` in the order of a hash of subject and ``seed``.

    Sources are dbpedia, wikidata, yago, card and csv. All flags come from one aggregation, not a join each.
    """
    has = {
        **{h: (F.col("p") == SAME_AS) & F.col("o").contains(h) for h in ("dbpedia", "wikidata", "yago")},
        "card": F.col("p") == ns.prop + "card",
        "csv": F.col("p").isin(ns.prop + "hairColor", ns.prop + "height"),
    }
    label = F.min(F.when((F.col("p") == LABEL) & F.coalesce(F.col("o_lang") == "en", F.lit(True)), F.col("o")))
    types = F.collect_set(F.when((F.col("p") == TYPE) & F.col("o").isin(*classes), F.col("o")))
    rows = graph.groupBy("s").agg(label.alias("label"), types.alias("types"), *[F.bool_or(has[x]).alias(f"has_{x}") for x in sources]).filter("label IS NOT NULL AND size(types) > 0")
    for x in sources:
        rows = rows.filter(f"has_{x}")
    rows = rows.select("s", F.explode("types").alias("type"), "label")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("type").orderBy("s"))).filter(F.col("n") <= most).drop("n")
    return rows if pick is None else rows.orderBy(F.md5(F.concat("s", F.lit(f":{seed}"))), "s", "type").limit(pick)


def entity_page(graph: DataFrame, seeds: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """One row per seed: label, description, image, types, labels (English first), properties and number of links."""
    own = likely(graph, "s", seeds, "entity").join(seeds.select(F.col("entity").alias("s")), "s", "left_semi")
    foreign = F.coalesce(F.col("o_lang") != "en", F.lit(False))
    first = lambda p: F.min(F.when(F.col("p") == p, F.struct(foreign, F.col("o"))))["o"]
    source = F.when(F.col("p").isin(ns.prop + "hairColor", ns.prop + "height"), "csv").otherwise("fandom")
    shown = ~F.col("p").isin(TYPE, LABEL, SAME_AS, SEE_ALSO, SCHEMA + "image", SCHEMA + "description")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    return own.groupBy("s").agg(
        first(LABEL).alias("label"),
        first(SCHEMA + "description").alias("description"),
        first(SCHEMA + "image").alias("image"),
        joined(F.when(F.col("p") == TYPE, local_name(F.col("o")))).alias("types"),
        joined(F.when(F.col("p") == LABEL, F.concat(F.when(foreign, "1").otherwise("0"), F.coalesce("o_lang", F.lit("")), F.lit(":"), F.col("o")))).alias("labels"),
        joined(F.when(shown, F.concat_ws("=", local_name(F.col("p")), F.col("o"), source))).alias("properties"),
        F.count_if(F.col("p").isin(SAME_AS, SEE_ALSO)).alias("n_links"),
    )


def card_pivot(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """One row per (entity, card) with the card's facts as columns."""
    wanted = {LABEL: "label", ns.prop + "cardType": "card_type", SCHEMA + "description": "description", ns.prop + "prowess": "prowess", ns.prop + "body": "body"}
    cards = graph.filter(F.col("p").isin(*wanted)).join(edges(graph, ns.prop + "card", o="card").select(F.col("card").alias("s")), "s", "left_semi")
    wide = cards.groupBy(F.col("s").alias("card")).pivot("p", list(wanted)).agg(F.min("o"))
    for p, name in wanted.items():
        wide = wide.withColumnRenamed(p, name)
    return edges(graph, ns.prop + "card", "entity", "card").join(wide, "card", "left")


def characters_with_links(graph: DataFrame, host: str = "dbpedia", ns: Namespaces = NS) -> DataFrame:
    """(s, label, link): labelled characters and, if stated, an equivalent at a host."""
    same = edges(graph, SAME_AS, o="link").filter(F.col("link").contains(host))
    return instances(graph, ns.ont + "Character").join(edges(graph, LABEL, o="label"), "s").join(same, "s", "left")


def pattern_join(graph: DataFrame, cls: str, p: str, name: str) -> DataFrame:
    """(s, label, value of p) of the labelled instances of a class."""
    return instances(graph, cls).join(edges(graph, LABEL, o="label"), "s").join(edges(graph, p, o=name), "s")


def entities_all_types(graph: DataFrame, cls: str) -> DataFrame:
    """(s, type): each instance of a class with each of its types."""
    return instances(graph, cls).join(edges(graph, TYPE, o="type"), "s", "left")


def exists(graph: DataFrame, seeds: DataFrame, predicates: dict[str, list[str]]) -> DataFrame:
    """One row per seed, one boolean per name: whether it has a triple of one of the predicates."""
    found = likely(graph, "s", seeds, "entity").join(seeds.select(F.col("entity").alias("s")), "s", "left_semi").groupBy("s").agg(*[F.bool_or(F.col("p").isin(*ps)).alias(n) for n, ps in predicates.items()])
    return seeds.select(F.col("entity").alias("s")).distinct().join(found, "s", "left").fillna(False, list(predicates))


def linked_entities(graph: DataFrame, limit: int | None = None) -> DataFrame:
    """(s, label, dbpedia, wikidata): labelled entities with at least one of two equivalents."""
    same = edges(graph, SAME_AS, o="uri")
    one = same.filter(F.col("uri").contains("dbpedia")).select("s", F.col("uri").alias("dbpedia"))
    two = same.filter(F.col("uri").contains("wikidata")).select("s", F.col("uri").alias("wikidata"))
    out = edges(graph, LABEL, o="label").join(one, "s", "left").join(two, "s", "left").filter("dbpedia IS NOT NULL OR wikidata IS NOT NULL")
    return out if limit is None else out.orderBy("s", "label", "dbpedia", "wikidata").limit(limit)


