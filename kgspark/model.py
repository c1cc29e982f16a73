"""Namespaces and the triple table: one row per fact, six columns, set semantics."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE_COLUMNS = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
TRIPLE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), c in ("o_dt", "o_lang")) for c in TRIPLE_COLUMNS])

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
FOAF = "http://xmlns.com/foaf/0.1/"
SCHEMA = "http://schema.org/"
SH = "http://www.w3.org/ns/shacl#"
DBPEDIA = "http://dbpedia.org/resource/"
YAGO = "http://yago-knowledge.org/resource/"
WIKIDATA = "http://www.wikidata.org/entity/"
TYPE, LABEL, SEE_ALSO, COMMENT = RDF + "type", RDFS + "label", RDFS + "seeAlso", RDFS + "comment"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
SAME_AS, INTEGER = OWL + "sameAs", XSD + "integer"


@dataclass(frozen=True)
class Namespaces:
    """Where a graph's own names live; the defaults are neutral."""

    base: str = "http://kg.example.org/"
    wiki: str = "https://wiki.example.org/wiki/"
    images: str = "https://wiki.example.org/w/images/"
    foreign_wiki: str = "https://fandom.example.org/"

    @property
    def res(self) -> str:
        return self.base + "resource/"

    @property
    def page(self) -> str:
        return self.base + "page/"

    @property
    def ont(self) -> str:
        return self.base + "ontology/"

    @property
    def prop(self) -> str:
        return self.base + "property/"

    @property
    def card(self) -> str:
        return self.base + "card/"


NS = Namespaces()


def fact(p: str | Column, o: Column, kind: str = "literal", lang: str | Column | None = None, dt: str | None = None) -> Column:
    """The part of a triple after its subject, as a struct; null where the object is null."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.when(o.isNotNull(), F.struct(text(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), text(dt).alias("o_dt"), text(lang).alias("o_lang")))


def iri(p: str | Column, o: Column) -> Column:
    return fact(p, o, "iri")


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: sorted and merged with the other, never broadcast.

    Before a query runs, Spark guesses sizes from compressed files and knows nothing of rows that an explode
    makes, so it would send such a side through the driver.
    """
    return df.hint("merge")


#: Objects of more characters, such as texts, are neither copied nor moved where their digests will do.
LONG = 256


def is_long(o: str = "o") -> Column:
    """Whether an object is long; characters are counted only where bytes don't settle it."""
    return (F.octet_length(o) > LONG) & (F.length(o) > LONG)


def _at(c: str, bits: int) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit(bits - 1))


def marks(keys: DataFrame, key: str, bits: int = 1 << 26, within: tuple[str, ...] = ()) -> DataFrame:
    """The filter that ``likely`` makes of keys, to be saved where several tables are held against the same keys."""
    words = keys.select(*[F.col(c).alias(f"_{c}") for c in within], _at(key, bits).alias("_at"))
    return words.groupBy(*[f"_{c}" for c in within], F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")).alias("_bits"))


def likely(
    df: DataFrame, by: str, keys: DataFrame | None, key: str, bits: int = 1 << 26, within: tuple[str, ...] = (), rest: bool = False, words: DataFrame | None = None
) -> DataFrame:
    """The rows of ``df`` whose column ``by`` is among some keys, and a few others, for a join with the keys to follow; ``rest``: all other rows.

    The keys' hashes set bits of a filter of fixed size, at most ``bits / 64`` rows of two numbers, which is broadcast. So the
    rows that no key is like are never shuffled; a crowded filter lets more of them through and changes no result.
    ``within``: columns of both that must agree; each of their combinations has ``bits`` of its own.
    ``words``: what ``marks`` made of the keys, with the same ``bits`` and ``within``.
    """
    words = marks(keys, key, bits, within) if words is None else words
    same = F.shiftright("_here", 6) == F.col("_word")
    for c in within:
        same = same & (F.col(c) == F.col(f"_{c}"))
    met = df.withColumn("_here", _at(by, bits)).join(F.broadcast(words), same, "left" if rest else "inner")
    hit = F.expr("shiftrightunsigned(_bits, CAST(_here & 63 AS INT)) & 1 = 1")
    return met.filter(~F.coalesce(hit, F.lit(False)) if rest else hit).select(*df.columns)


def facts_to_triples(df: DataFrame, subject: str, facts: Column) -> DataFrame:
    """One row per struct of an array of facts; nulls are left out.

    ``explode_outer``, since for ``explode`` Spark adds a filter on the array's size, which it pushes down to where the array
    is made: all facts would be made twice.
    """
    return df.select(F.col(subject).alias("s"), F.explode_outer(facts).alias("f")).filter("f IS NOT NULL").select("s", "f.*").filter("s IS NOT NULL")


def triples_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small constant graph; rows are (s, p, o, kind[, datatype[, language]])."""
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], TRIPLE_SCHEMA)


def merge(*graphs: DataFrame) -> DataFrame:
    """Set union of graphs."""
    out = graphs[0].select(*TRIPLE_COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*TRIPLE_COLUMNS))
    return out.dropDuplicates()


def added(before: DataFrame, more: DataFrame) -> DataFrame:
    """The triples that a merge of ``more`` into ``before`` adds, as a set; neither side needs to be one."""
    both = more.select(*TRIPLE_COLUMNS, F.lit(True).alias("new")).unionByName(before.select(*TRIPLE_COLUMNS, F.lit(False).alias("new")))
    # One shuffle makes the triples a set and holds them against the graph.
    return both.groupBy(*TRIPLE_COLUMNS).agg(F.bool_and("new").alias("new")).filter("new").select(*TRIPLE_COLUMNS)


def delete(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """Set difference."""
    return graph.select(*TRIPLE_COLUMNS).subtract(gone.select(*TRIPLE_COLUMNS))


def match(graph: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The triples of a pattern; a part left out matches anything. Filters reach the scan."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            graph = graph.filter(F.col(name) == value)
    return graph


def edges(graph: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    """(s, o) of one predicate, renamed."""
    return match(graph, p=p).select(F.col("s").alias(s), F.col("o").alias(o))


def instances(graph: DataFrame, cls: str, name: str = "s") -> DataFrame:
    """Distinct instances of a class."""
    return match(graph, p=TYPE, o=cls).select(F.col("s").alias(name)).distinct()


def first_label(graph: DataFrame, p: str = LABEL) -> DataFrame:
    """(s, label): one value per subject, English or untagged ones first, then the least."""
    foreign = F.col("o_lang").isNotNull() & (F.col("o_lang") != "en")
    return match(graph, p=p).groupBy("s").agg(F.min(F.struct(foreign.alias("foreign"), "o"))["o"].alias("label"))


def clear(graph: DataFrame) -> DataFrame:
    """The graph without its triples."""
    return graph.select(*TRIPLE_COLUMNS).filter(F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where nothing is set, a fresh temporary one.

    On a cluster executors don't share a temporary folder, so there a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
