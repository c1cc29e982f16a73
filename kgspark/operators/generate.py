"""Triples of parsed pages: one array of (subject, fact) per page, of both directions, exploded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import entity_iri, image_hash_url, image_name, is_valid_date, page_iri, split_on_br, trim_ws, underscored
from kgspark.model import FOAF, LABEL, NS, SAME_AS, SCHEMA, SEE_ALSO, TRIPLE_COLUMNS, TYPE, Namespaces, fact, facts_to_triples, iri, large

#: Link titles that are no children.
NO_CHILDREN = ("twins", "twin", "several", "many", "unknown", "none")
#: What the facts below read of a page, for ``parse_pages``; an image and other names are read as they are written.
READ = {
    "plain": ("name", "gender", "race", "people", "description", "type", "result", "outcome"),
    "links": ("race", "people", "birthlocation", "deathlocation", "spouse", "children", "parentage", "siblings", "location", "realm", "owner", "creator", "maker"),
    "dates": ("birth", "death", "founded", "destroyed", "date"),
}
CHARACTER, PLACE, OBJECT, EVENT = (("character",), ("place", "location"), ("object", "weapon", "artifact"), ("event", "battle", "war"))


def _plain(key: str) -> Column:
    return F.try_element_at("plain", F.lit(key))


def _links(key: str) -> Column:
    return F.coalesce(F.try_element_at("links", F.lit(key)), F.array().cast("array<string>"))


def _date(key: str, valid: bool = False) -> Column:
    date = F.try_element_at("dates", F.lit(key))
    return F.when((date != "") & (is_valid_date(date) if valid else F.lit(True)), date)


def _each(p: str, key: str, ns: Namespaces) -> Column:
    return F.transform(_links(key), lambda x: iri(p, entity_iri(x, ns)))


def _first(p: str, key: str, ns: Namespaces) -> Column:
    return F.array(iri(p, entity_iri(F.get(_links(key), F.lit(0)), ns)))


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def type_iris(itype: Column, ns: Namespaces = NS) -> Column:
    """The class IRIs of an entity type."""
    pair = lambda a, b: F.array(F.lit(SCHEMA + a), F.lit(ns.ont + b))
    return (
        F.when(itype == "character", pair("Person", "Character"))
        .when(itype.isin(*PLACE), pair("Place", "Location"))
        .when(itype.isin(*OBJECT), pair("Thing", "Artifact"))
        .when(itype == "book", F.array(F.lit(SCHEMA + "Book")))
        .when(itype == "battle", pair("Event", "Battle"))
        .when(itype == "war", pair("Event", "War"))
        .when(itype == "event", F.array(F.lit(SCHEMA + "Event")))
        .otherwise(F.array(F.lit(SCHEMA + "Thing")))
    )


def character_facts(ns: Namespaces = NS) -> Column:
    others = F.transform(split_on_br(F.try_element_at("params", F.lit("othernames"))), lambda x: x)
    gender = F.lower(_plain("gender"))
    return F.concat(
        F.array(fact(SCHEMA + "name", _plain("name"), lang="en"), fact(SCHEMA + "gender", F.when(gender.isin("male", "female"), gender))),
        F.transform(F.filter(F.transform(others, flat_text), lambda x: ~F.lower(x).isin("see below", "")), lambda x: fact(SCHEMA + "alternateName", x)),
        *[part for key in ("race", "people") for part in (_each(ns.ont + "race", key, ns), F.array(fact(ns.prop + "raceLabel", _some(_plain(key)))))],
        F.array(fact(SCHEMA + "birthDate", _date("birth", True)), fact(SCHEMA + "deathDate", _date("death", True))),
        _first(SCHEMA + "birthPlace", "birthlocation", ns),
        _first(SCHEMA + "deathPlace", "deathlocation", ns),
        _each(SCHEMA + "spouse", "spouse", ns),
        F.transform(F.filter(_links("children"), lambda x: ~F.lower(x).isin(*NO_CHILDREN)), lambda x: iri(SCHEMA + "children", entity_iri(x, ns))),
        _each(SCHEMA + "parent", "parentage", ns),
        _each(SCHEMA + "sibling", "siblings", ns),
    )


def flat_text(c: Column) -> Column:
    """Display text of wikitext without nested templates and links, by built-in expressions."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->|\{\{[^{}]*\}\}|'{2,}|\[\d+\]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1"), "<[^>]+>", "")
    return F.regexp_replace(trim_ws(F.regexp_replace(out, r"(?U)\s+", " ")), "^[\"']+|[\"']+$", "")


def place_facts(ns: Namespaces = NS) -> Column:
    return F.concat(
        F.array(
            fact(SCHEMA + "name", _plain("name"), lang="en"),
            fact(SCHEMA + "foundingDate", _date("founded")),
            fact(ns.prop + "destroyedDate", _date("destroyed")),
            fact(SCHEMA + "description", _some(_plain("description")), lang="en"),
        ),
        _each(SCHEMA + "containedInPlace", "location", ns),
        _each(ns.prop + "realm", "realm", ns),
    )


def object_facts(ns: Namespaces = NS) -> Column:
    """Without the inverse edges of owners, which have another subject: see ``ownership``."""
    return F.concat(
        F.array(fact(SCHEMA + "name", _plain("name"), lang="en"), fact(ns.prop + "objectType", _plain("type"))),
        _each(ns.prop + "ownedBy", "owner", ns),
        _each(SCHEMA + "creator", "creator", ns),
        _each(SCHEMA + "creator", "maker", ns),
    )


def event_facts(ns: Namespaces = NS) -> Column:
    return F.concat(
        F.array(
            fact(SCHEMA + "name", _plain("name"), lang="en"),
            fact(SCHEMA + "startDate", _date("date")),
            fact(ns.prop + "result", _some(F.coalesce(_plain("result"), _plain("outcome")))),
        ),
        _each(SCHEMA + "location", "location", ns),
    )


def with_iris(parsed: DataFrame, ns: Namespaces = NS) -> DataFrame:
    return parsed.withColumns({"entity": entity_iri(F.col("title"), ns), "doc": page_iri(F.col("title"), ns)})


def _of(subject: Column, facts: Column) -> Column:
    """Facts with their subject, as an array of (s, f)."""
    return F.transform(facts, lambda f: F.struct(subject.alias("s"), f.alias("f")))


def exploded(rows: DataFrame, facts: Column) -> DataFrame:
    """The triples of an array of (s, f); nulls are left out. ``explode_outer``: see ``facts_to_triples``."""
    return rows.select(F.explode_outer(facts).alias("x")).select("x.s", "x.f").filter("s IS NOT NULL AND f IS NOT NULL").select("s", "f.*")


def base_facts(ns: Namespaces = NS) -> Column:
    """Topic both ways, document type, label, address both ways: of pages with their IRIs."""
    url = F.concat(F.lit(ns.wiki), underscored(F.col("title")))
    entity = F.array(iri(FOAF + "isPrimaryTopicOf", F.col("doc")), fact(LABEL, F.col("title"), lang="en"), iri(SEE_ALSO, url))
    doc = F.array(iri(FOAF + "primaryTopic", F.col("entity")), iri(TYPE, F.lit(FOAF + "Document")), iri(SCHEMA + "url", url))
    return F.concat(_of(F.col("entity"), entity), _of(F.col("doc"), doc))


def base_triples(pages: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """The six triples of any page."""
    return exploded(with_iris(pages, ns), base_facts(ns))


def type_triples(parsed: DataFrame, ns: Namespaces = NS) -> DataFrame:
    return facts_to_triples(with_iris(parsed, ns), "entity", F.transform(type_iris(F.col("itype"), ns), lambda x: iri(TYPE, x)))


def body_triples(parsed: DataFrame, facts: Column, types: tuple[str, ...] | None, ns: Namespaces = NS) -> DataFrame:
    """The facts of pages of the given types (None: all)."""
    rows = parsed if types is None else parsed.filter(F.col("itype").isin(*types))
    return facts_to_triples(with_iris(rows, ns), "entity", facts)


def owner_facts(ns: Namespaces = NS) -> Column:
    """The inverse edges of owners: owner owns object."""
    return F.transform(_links("owner"), lambda x: F.struct(entity_iri(x, ns).alias("s"), iri(SCHEMA + "owns", F.col("entity")).alias("f")))


def ownership(parsed: DataFrame, ns: Namespaces = NS) -> DataFrame:
    return exploded(with_iris(parsed.filter(F.col("itype").isin(*OBJECT)), ns), owner_facts(ns))


def image_triples(parsed: DataFrame, imageinfo: DataFrame | None = None, ns: Namespaces = NS) -> DataFrame:
    """The image of a page: its address in the image table, else the one its name gives."""
    rows = with_iris(parsed, ns).select("entity", F.try_element_at("params", F.lit("image")).alias("file")).filter("file IS NOT NULL")
    rows = rows.withColumn("filename", image_name(F.col("file")))
    if imageinfo is not None:
        rows = rows.join(large(imageinfo.select("filename", "url")), "filename", "left")
    known = F.col("url") if imageinfo is not None else F.lit(None).cast("string")
    return facts_to_triples(rows, "entity", F.array(iri(SCHEMA + "image", F.coalesce(known, image_hash_url(F.col("file"), ns)))))


def _link_property() -> Column:
    return F.when(F.col("link_type") == "wikipedia", SEE_ALSO).when(F.col("link_type").isin("dbpedia", "wikidata", "yago"), SAME_AS)


def link_triples(links: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """Equivalences and references of discovered links; ``links`` has name, link_type and uri."""
    rows = links.filter(_link_property().isNotNull()).withColumn("entity", entity_iri(F.col("name"), ns))
    return facts_to_triples(rows, "entity", F.array(iri(_link_property(), F.col("uri"))))


def page_facts(parsed: DataFrame, links: DataFrame | None = None, imageinfo: DataFrame | None = None, ns: Namespaces = NS) -> DataFrame:
    """(title, facts): all facts of each page with an infobox, with their subjects, as one array; a fact that a page states twice repeats.

    Pages of other types, books among them, are read like characters. A page is parsed and its
    facts are built once; the image table and the links, ``links`` grouped by name, join the
    arrays, not the triples.
    """
    own = with_iris(parsed.filter("template IS NOT NULL"), ns)  # status is success; Spark sees that pages that weren't parsed have none
    kind, entity = F.col("itype"), F.col("entity")
    body = F.when(kind.isin(*PLACE), place_facts(ns)).when(kind.isin(*OBJECT), object_facts(ns)).when(kind.isin(*EVENT), event_facts(ns)).otherwise(character_facts(ns))
    types = F.transform(type_iris(kind, ns), lambda x: iri(TYPE, x))
    owned = F.when(kind.isin(*OBJECT), owner_facts(ns)).otherwise(F.array().cast("array<struct<s:string,f:struct<p:string,o:string,o_kind:string,o_dt:string,o_lang:string>>>"))
    image = F.try_element_at("params", F.lit("image"))
    rows = own.select("title", "entity", image_name(image).alias("filename"), image_hash_url(image, ns).alias("url"), F.concat(base_facts(ns), _of(entity, F.concat(types, body)), owned).alias("facts"))
    if imageinfo is not None:
        known = imageinfo.filter("filename IS NOT NULL").groupBy("filename").agg(F.min("url").alias("known"))
        # Pages without an image are spread by their titles, which no name of a file begins like.
        rows = rows.withColumn("file", F.coalesce("filename", F.concat(F.lit("\0"), "title")))
        rows = rows.join(large(known.withColumnRenamed("filename", "file")), "file", "left").withColumn("url", F.coalesce("known", "url"))
    facts = [F.col("facts"), _of(entity, F.array(iri(SCHEMA + "image", F.col("url"))))]
    if links is not None:
        by_name = links.select(F.col("name").alias("title"), iri(_link_property(), F.col("uri")).alias("link")).filter("link IS NOT NULL").groupBy("title").agg(F.collect_set("link").alias("found"))
        rows = rows.join(large(by_name), "title", "left")
        facts.append(_of(entity, F.coalesce("found", F.array().cast(by_name.schema["found"].dataType))))
    return rows.select("title", F.filter(F.concat(*facts), lambda x: x["s"].isNotNull() & x["f"].isNotNull()).alias("facts"))


def page_graphs(parsed: DataFrame, links: DataFrame | None = None, imageinfo: DataFrame | None = None, ns: Namespaces = NS) -> DataFrame:
    """The triples of each page with an infobox; those that pages share repeat."""
    return exploded(page_facts(parsed, links, imageinfo, ns), F.col("facts")).select(*TRIPLE_COLUMNS)


def generate_graph(parsed: DataFrame, links: DataFrame | None = None, imageinfo: DataFrame | None = None, ns: Namespaces = NS) -> DataFrame:
    """All triples of pages with an infobox, as a set."""
    return page_graphs(parsed, links, imageinfo, ns).dropDuplicates()


def page_sizes(facts: DataFrame) -> DataFrame:
    """(title, triples): the size of each page's own graph, before graphs are merged."""
    # As strings, since Spark holds each struct of an array against every other one.
    distinct = F.array_distinct(F.transform("facts", lambda x: F.to_json(x)))
    return facts.select("title", F.size(distinct).cast("long").alias("triples"))


def category_pages(members: DataFrame, categories: DataFrame, default_limit: int = 50) -> DataFrame:
    """(cat_idx, category, pos, title): the first members of each category in the main namespace, up to its limit."""
    wanted = categories.select("cat_idx", "category", F.coalesce("lim", F.lit(default_limit)).alias("lim"))
    most = wanted.agg(F.max("lim")).first()[0] or 0
    rank = F.row_number().over(W.partitionBy("category").orderBy("pos", "title"))
    own = members.filter("ns = 0").withColumn("rank", rank).filter(F.col("rank") <= most)  # Spark keeps the first ones of each task
    return own.join(wanted, "category").filter("rank <= lim").select("cat_idx", "category", "pos", "title")


def select_categories(categories: DataFrame, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The categories picked, with their own or the given limit; none picked: all."""
    out = categories if names is None else categories.filter(F.col("category").isin(*names))
    return out if limit is None else out.withColumn("lim", F.lit(limit))


def dedupe_pages(category_titles: DataFrame, statuses: DataFrame) -> DataFrame:
    """Titles with their status and a flag for repeats: a title counts once, at its first place, unless it ended in an error."""
    ordered = W.partitionBy("title").orderBy("cat_idx", "pos")
    ended = category_titles.join(large(statuses.select("title", "status")), "title", "left").withColumn("status", F.coalesce("status", F.lit("no_page")))
    failed = F.col("status").isin("no_page") | F.col("status").startswith("error")
    return ended.withColumn("duplicate", (F.row_number().over(ordered) > 1) & ~failed)


def category_stats(processed: DataFrame) -> DataFrame:
    """Counts per category of pages processed, succeeded, skipped, failed and repeated."""
    fresh = ~F.col("duplicate")
    failed = F.col("status").isin("no_page") | F.col("status").startswith("error")
    return processed.groupBy("cat_idx", "category").agg(
        F.count_if(fresh).alias("processed"),
        F.count_if(fresh & (F.col("status") == "success")).alias("success"),
        F.count_if(fresh & (F.col("status") == "no_infobox")).alias("skipped"),
        F.count_if(fresh & failed).alias("errors"),
        F.count_if("duplicate").alias("duplicates"),
    )


def build_stats(processed: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Totals of a build, as one row; ``page_sizes`` has title and triples, counted before graphs are merged."""
    fresh = ~F.col("duplicate")
    failed = F.col("status").isin("no_page") | F.col("status").startswith("error")
    return processed.join(large(page_sizes), "title", "left").agg(
        F.count_if(fresh).alias("processed"),
        F.count_if(fresh & (F.col("status") == "success")).alias("success"),
        F.count_if(fresh & (F.col("status") == "no_infobox")).alias("no_infobox"),
        F.count_if(fresh & failed).alias("errors"),
        F.coalesce(F.sum(F.when(fresh, F.col("triples"))), F.lit(0)).alias("triples"),
        F.lit(0).cast("long").alias("external_links_found"),
        F.count_if("duplicate").alias("duplicates_skipped"),
    )
