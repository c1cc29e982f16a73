"""Inference over class hierarchies and equivalences, for a table of seed entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.model import LABEL, SAME_AS, SUBCLASS, TRIPLE_COLUMNS, TYPE, checkpointed, edges, likely, match
from kgspark.sources.ordered import Finder, scan


def subclass_closure(graph: DataFrame, p: str = SUBCLASS) -> DataFrame:
    """(class, ancestor): reflexive and transitive, at any depth and safe on cycles.

    Each pair keeps its least number of steps. A round knows all pairs of up to n steps and joins
    those of exactly n, the frontier, with all: whatever is up to 2n steps away lies that far
    behind a pair of the frontier. So a chain or a cycle of a thousand classes takes ten rounds, and
    where classes have few parents each pair is made about once; earlier pairs are never written again.
    """
    step = edges(graph, p, "class", "ancestor").filter("class IS NOT NULL AND ancestor IS NOT NULL")
    same = step.select(F.explode(F.array("class", "ancestor")).alias("class")).withColumn("ancestor", F.col("class"))
    pairs = step.filter("class <> ancestor").withColumn("steps", F.lit(1)).unionByName(same.withColumn("steps", F.lit(0)))
    known, length = checkpointed(pairs.distinct()), 1
    while True:
        frontier = known.filter(F.col("steps") == length)
        if frontier.isEmpty():
            return known.select("class", "ancestor")
        up = known.filter("steps > 0").select(F.col("class").alias("through"), F.col("ancestor").alias("further"), F.col("steps").alias("more"))
        reached = frontier.join(up, F.col("ancestor") == F.col("through")).groupBy("class", F.col("further").alias("ancestor")).agg((F.min("more") + length).alias("steps"))
        known = known.unionByName(checkpointed(reached.join(known, ["class", "ancestor"], "left_anti")))
        length *= 2


def with_ancestors(types: DataFrame, closure: DataFrame) -> DataFrame:
    """(entity, class): each type with all its ancestors; a class without edges still reaches itself."""
    up = closure.select(F.col("class").alias("type"), "ancestor")
    return types.join(up, "type", "left").select("entity", F.coalesce("ancestor", "type").alias("class")).distinct()


def _types(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity, type) as stated; an inner join with a set of seeds, since Spark would push a semi-join down before the filter, and so shuffle all types."""
    return likely(edges(graph, TYPE, "entity", "type"), "entity", seeds, "entity").join(seeds.select("entity").distinct(), "entity")


def all_classes(graph: DataFrame, seeds: DataFrame, closure: DataFrame) -> DataFrame:
    """(entity, class, class_label) of the seeds' direct and inherited classes."""
    types = _types(graph, seeds)
    labels = edges(graph, LABEL, "class", "class_label")
    return with_ancestors(types, closure).join(labels, "class", "left").select("entity", "class", "class_label").distinct()


def describe(graph: DataFrame, seeds: DataFrame, find: Finder | None = None) -> DataFrame:
    """All triples with a seed as subject or object; ``find``, here and below, looks them up instead of reading the graph."""
    return _described(graph, seeds, find).dropDuplicates()


def _described(graph: DataFrame, seeds: DataFrame, find: Finder | None = None) -> DataFrame:
    """The triples of ``describe``, some of them twice."""
    find = find or scan(graph)
    keys = seeds.select("entity").distinct()
    out, into = find(keys, "entity", "s"), find(keys, "entity", "o")
    return out.select(*TRIPLE_COLUMNS).unionByName(into.select(*TRIPLE_COLUMNS))


def _same(graph: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, same) of equivalences stated from, and to, the seeds; a saved graph has a folder of them, which is far less than a copy."""
    out = edges(graph, SAME_AS, "entity", "same").join(seeds, "entity", "left_semi")
    into = edges(graph, SAME_AS, "same", "entity").join(seeds, "entity", "left_semi").select("entity", "same")
    return out, into


def _asked(*sides: tuple[DataFrame, str, str]) -> DataFrame:
    """(entity, key, source): what is looked up at once, from tables of keys, each with its column of keys and its name."""
    parts = [keys.select("entity", F.col(key).alias("key"), F.lit(source).alias("source")) for keys, key, source in sides]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def relations_with_sameas(graph: DataFrame, seeds: DataFrame, find: Finder | None = None) -> DataFrame:
    """(entity, subject, predicate, object, source): direct relations and those of stated equivalents, in two lookups."""
    out, into = _same(graph, seeds)
    find = find or scan(graph)

    def part(keys: DataFrame, by: str) -> DataFrame:
        rows = find(keys, "key", by).filter((F.col("source") == "direct") | (F.col("p") != SAME_AS))
        return rows.select("entity", F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "source")

    subjects = _asked((seeds, "entity", "direct"), (out, "same", "sameAs-outgoing"), (into, "same", "sameAs-incoming"))
    objects = _asked((seeds, "entity", "direct"), (out, "same", "sameAs-as-object"))
    return part(subjects, "s").unionByName(part(objects, "o")).distinct()


def describe_with_inference(graph: DataFrame, seeds: DataFrame, closure: DataFrame, find: Finder | None = None) -> DataFrame:
    """The description of the seeds with inherited types and equivalences turned to start from the seed."""
    out, into = _same(graph, seeds)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("o_dt", "o_lang")]
    own = _types(graph, seeds)
    types = with_ancestors(own, closure)
    inferred = types.select(F.col("entity").alias("s"), F.lit(TYPE).alias("p"), F.col("class").alias("o"), F.lit("iri").alias("o_kind"), *nothing)
    same = out.unionByName(into).select(F.col("entity").alias("s"), F.lit(SAME_AS).alias("p"), F.col("same").alias("o"), F.lit("iri").alias("o_kind"), *nothing)
    return inferred.unionByName(_described(graph, seeds, find)).unionByName(same).dropDuplicates()


def inferred_types(graph: DataFrame, cls: str, closure: DataFrame, limit: int | None = None) -> DataFrame:
    """(s, label, inferred_type): labelled instances of a class with each of the class's ancestors."""
    up = closure.filter(F.col("class") == cls).select(F.lit(cls).alias("class"), F.col("ancestor").alias("inferred_type"))
    own = match(graph, p=TYPE, o=cls).select("s", F.col("o").alias("class"))
    out = own.join(edges(graph, LABEL, o="label"), "s").join(up, "class").select("s", "label", "inferred_type").distinct()
    return out if limit is None else out.orderBy("s", "label", "inferred_type").limit(limit)


def related_via_sameas(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity, related, predicate, direction): equivalents, and the IRIs that stated equivalents point at."""
    out, into = _same(graph, seeds)
    equal = out.unionByName(into).select("entity", F.col("same").alias("related"), F.lit(SAME_AS).alias("predicate"), F.lit("equivalent").alias("direction"))
    far = scan(graph.filter((F.col("p") != SAME_AS) & (F.col("o_kind") == "iri")))(out, "same", "s")
    return equal.unionByName(far.select("entity", F.col("o").alias("related"), F.col("p").alias("predicate"), F.lit("via-sameAs").alias("direction"))).distinct()


def external_facts(graph: DataFrame, external: DataFrame, host: str = "dbpedia.org", most: int | None = None) -> DataFrame:
    """(entity, property, value): facts of the equivalents at a host, English or without language, up to ``most`` per entity (None: all)."""
    same = edges(graph, SAME_AS, "entity", "same").filter(F.col("same").contains(host)).distinct()
    facts = external.filter(F.col("o_lang").isNull() | (F.col("o_lang") == "en")).join(same, F.col("s") == F.col("same")).select("entity", F.col("p").alias("property"), F.col("o").alias("value"))
    return facts if most is None else facts.withColumn("n", F.row_number().over(W.partitionBy("entity").orderBy("property", "value"))).filter(F.col("n") <= most).drop("n")


def relations_out_sameas(graph: DataFrame, seeds: DataFrame, find: Finder | None = None) -> DataFrame:
    """(entity, predicate, object): outgoing relations of the seeds and of their stated equivalents, repeats kept."""
    out, _ = _same(graph, seeds)
    rows = (find or scan(graph))(_asked((seeds, "entity", "own"), (out, "same", "same")), "key", "s")
    return rows.select("entity", F.col("p").alias("predicate"), F.col("o").alias("object"))


def inference_report(graph: DataFrame, seeds: DataFrame, closure: DataFrame) -> DataFrame:
    """Per entity the number of its classes, relations and related entities, and its classes as a sorted list."""
    classes = all_classes(graph, seeds, closure).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("class")), " ").alias("classes"), F.count_distinct("class").alias("n_classes"))
    relations = relations_with_sameas(graph, seeds).groupBy("entity").agg(F.count("*").alias("n_relations"))
    related = related_via_sameas(graph, seeds).groupBy("entity").agg(F.count("*").alias("n_related"))
    out = seeds.select("entity").distinct().join(classes, "entity", "left").join(relations, "entity", "left").join(related, "entity", "left")
    return out.fillna(0, ["n_classes", "n_relations", "n_related"])


def reasoning_page(classes: DataFrame, relations: DataFrame, related: DataFrame) -> DataFrame:
    """(entity, part, value, note): rows of a page, marked as inferred or typed by host."""
    inferred = F.when(F.col("class").contains("schema.org") | F.col("class").contains("Thing"), "inferred").otherwise("direct")
    by_host = F.lit("unknown")
    for host in ("wikipedia", "yago", "wikidata", "dbpedia"):
        by_host = F.when(F.col("related").contains(host), host).otherwise(by_host)
    return (
        classes.select("entity", F.lit("class").alias("part"), F.col("class").alias("value"), inferred.alias("note"))
        .unionByName(relations.select("entity", F.lit("relation").alias("part"), F.concat_ws(" ", "subject", "predicate", "object").alias("value"), F.when(F.col("source").contains("sameAs"), "inferred").otherwise("direct").alias("note")))
        .unionByName(related.filter("direction = 'equivalent'").select("entity", F.lit("equivalent").alias("part"), F.col("related").alias("value"), by_host.alias("note")))
        .distinct()
    )
