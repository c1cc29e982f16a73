"""Writers: Parquet by predicate, N-Triples, Turtle, JSON-LD, RDF/XML."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.model import FOAF, NS, OWL, RDF, RDFS, SCHEMA, TRIPLE_COLUMNS, TYPE, XSD, Namespaces
from kgspark.operators.ontology import ontology_triples, shape_triples


def escape(c: Column) -> Column:
    out = c
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def object_term() -> Column:
    """The object as an N-Triples term."""
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    return F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), tail))


def to_ntriples(graph: DataFrame) -> DataFrame:
    """(line): one line per triple."""
    return graph.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), object_term(), F.lit(" .")).alias("line"))


def prefixes(ns: Namespaces = NS) -> dict[str, str]:
    return {"res": ns.res, "page": ns.page, "ont": ns.ont, "prop": ns.prop, "card": ns.card, "schema": SCHEMA, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "foaf": FOAF, "xsd": XSD}


#: A block is closed after so many lines or characters; a subject of more has several blocks.
MOST_LINES, MOST_CHARACTERS = 10_000, 1 << 20
#: Lines of one compressed file of triples.
MOST_FILE_LINES = 1_000_000


def blocks(graph: DataFrame, key: Column, line: Column, name: str, head: str, between: str, tail: str, most_lines: int | None = MOST_LINES, quoted: Callable[[str], str] = str) -> DataFrame:
    """(s, block): the lines of a subject's triples in order of (key, line), with a text around and between them.

    Triples are dealt by ranges of (s, p, o), so a hub is spread over tasks; lines are made and sorted
    there, and each task writes blocks as it reads, holding one at a time. A subject that a range
    or ``most_lines`` cuts goes on in another block, which all formats here read as the same
    subject. With ``most_lines`` None each subject has one block, as large as it is. ``head`` and ``tail`` may hold
    ``{s}``, ``quoted`` by the format; lines of an equal non-null key are put together as ``key[line,line]``.
    """
    dealt = graph.select(*TRIPLE_COLUMNS).repartitionByRange(*(("s",) if most_lines is None else ("s", "p", "o")))
    ordered = dealt.select("s", key.cast("string").alias("key"), line.alias("line")).sortWithinPartitions("s", "key", "line")
    full = lambda n, size: most_lines is not None and (n >= most_lines or size >= MOST_CHARACTERS)

    def block(subject: str, own: list[tuple[str | None, str]]) -> str:
        if own[0][0] is None:
            body = between.join(line for _, line in own)
        else:
            keyed: dict[str, list[str]] = {}
            for key, line in own:
                keyed.setdefault(key, []).append(line)
            body = between.join(f"{key}[{','.join(some)}]" for key, some in keyed.items())
        return head.replace("{s}", quoted(subject)) + body + tail

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, own, size, done, length = None, [], 0, [], 0
        for batch in batches:
            for s, key, line in zip(batch["s"], batch["key"], batch["line"], strict=True):
                if own and (s != subject or full(len(own), size)):
                    done.append((subject, block(subject, own)))
                    length += size
                    own, size = [], 0
                    if len(done) >= 10_000 or length >= 8 * MOST_CHARACTERS:
                        yield pd.DataFrame(done, columns=["s", name])
                        done, length = [], 0
                subject = s
                own.append((key, line))
                size += len(line)
        if own:
            done.append((subject, block(subject, own)))
        if done:
            yield pd.DataFrame(done, columns=["s", name])

    return ordered.mapInPandas(run, f"s string, {name} string")


def to_turtle(graph: DataFrame, most_lines: int | None = MOST_LINES) -> DataFrame:
    """(s, block): predicates and objects of a subject in order; a hub has several blocks."""
    pair = F.concat(F.when(F.col("p") == TYPE, "a").otherwise(F.concat(F.lit("<"), "p", F.lit(">"))), F.lit(" "), object_term())
    return blocks(graph, F.lit(None), pair, "block", "<{s}> ", " ;\n    ", " .", most_lines)


def to_jsonld(graph: DataFrame, most_lines: int | None = MOST_LINES) -> DataFrame:
    """(s, node): JSON-LD node objects, one per subject; a hub has several with its id."""
    value = (
        F.when(F.col("o_kind") == "iri", F.to_json(F.struct(F.col("o").alias("@id"))))
        .when(F.col("o_lang").isNotNull(), F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_lang").alias("@language"))))
        .when(F.col("o_dt").isNotNull(), F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_dt").alias("@type"))))
        .otherwise(F.to_json(F.struct(F.col("o").alias("@value"))))
    )
    key = F.concat(F.lit('"'), F.col("p"), F.lit('":'))
    return blocks(graph, key, value, "node", '{"@id":"{s}",', ",", "}", most_lines)


_XML_CODES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _xml(c: Column) -> Column:
    for char, code in _XML_CODES:
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def to_rdfxml(graph: DataFrame, most_lines: int | None = MOST_LINES) -> DataFrame:
    """(s, element): description elements, one per subject, several for a hub; each property names its own namespace."""
    local = F.regexp_extract("p", r"([^/#]*)$", 1)
    space = F.regexp_replace("p", r"[^/#]*$", "")
    opening = F.concat(F.lit("<p:"), local, F.lit(' xmlns:p="'), _xml(space), F.lit('"'))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"'))).when(F.col("o_dt").isNotNull(), F.concat(F.lit(' rdf:datatype="'), "o_dt", F.lit('"'))).otherwise("")
    element = F.when(F.col("o_kind") == "iri", F.concat(opening, F.lit(' rdf:resource="'), _xml(F.col("o")), F.lit('"/>'))).otherwise(F.concat(opening, tail, F.lit(">"), _xml(F.col("o")), F.lit("</p:"), local, F.lit(">")))

    def quoted(text: str) -> str:  # within the function, so that executors get it by value
        for char, code in _XML_CODES:
            text = text.replace(char, code)
        return text

    return blocks(graph, F.lit(None), element, "element", '<rdf:Description rdf:about="{s}">', "", "</rdf:Description>", most_lines, quoted)


def wrapped(lines: DataFrame, head: str, tail: str) -> DataFrame:
    """Text rows with a head and a tail around each partition, so each part file is a whole document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        for batch in batches:
            yield batch
        yield pd.DataFrame({"value": [tail]})

    return lines.toDF("value").mapInPandas(run, "value string")


def write_ontology(spark: SparkSession, path: str, fmt: str = "turtle", ns: Namespaces = NS) -> None:
    """The vocabulary as text files."""
    export_graph(ontology_triples(spark, ns), path, fmt)


def write_shapes(spark: SparkSession, path: str, fmt: str = "turtle", ns: Namespaces = NS) -> None:
    """The basic shapes as text files."""
    export_graph(shape_triples(spark, ns), path, fmt)


def export_graph(graph: DataFrame, path: str, fmt: str, compression: str = "none") -> None:
    """The whole graph as text files: nt, turtle, jsonld (a node per line) or xml.

    ``compression``: a codec of Spark's text files, such as gzip, which Spark reads by its suffix; a compressed file isn't split,
    so lines of triples then make several files of bounded size per task.
    """
    if fmt == "nt":
        out = to_ntriples(graph)
    elif fmt == "turtle":
        out = wrapped(to_turtle(graph).select("block"), "\n".join(f"@prefix {k}: <{v}> ." for k, v in prefixes().items()), "")
    elif fmt == "jsonld":
        out = to_jsonld(graph).select("node")
    elif fmt == "xml":
        out = wrapped(to_rdfxml(graph).select("element"), f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>")
    else:
        raise ValueError(f"unknown format {fmt}")
    bounded = MOST_FILE_LINES if fmt == "nt" and compression != "none" else 0
    out.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", bounded).text(path)
