"""Readers: page dumps, card files, character tables, saved graphs, links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.model import TRIPLE_COLUMNS
from kgspark.sources.jsonsplit import split_cards


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(title, wikitext) from Parquet, JSON lines, or a wiki's XML dump with one ``page`` element per page."""
    if fmt == "xml":
        pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text: string>").load(path)
        return pages.select("title", F.col("revision.text").alias("wikitext"))
    return spark.read.schema("title string, wikitext string").format(fmt).load(path)


def cards_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Flat cards of texts that each hold {set: {cards: {id: card}}} or cards by themselves.

    Sets are dealt out again after the first explode, since a text is one row; files are better read by ``read_cards``. ``pos`` is
    the place in the file's order; names and texts may be strings or {language: string}; what is
    no object is left out.
    """
    named = "map<string,string>"
    sets = texts.select(F.posexplode(F.from_json(F.col(column), named)).alias("set_pos", "set_id", "body")).filter(F.col("body").startswith("{")).repartition("set_id")
    inner = F.get_json_object("body", "$.cards")
    many = sets.filter(inner.isNotNull()).select("set_pos", F.posexplode(F.from_json(inner, named)).alias("card_pos", "key", "card")).filter(F.col("card").startswith("{"))
    alone = sets.filter(inner.isNull()).select("set_pos", F.lit(0).alias("card_pos"), F.col("set_id").alias("key"), F.col("body").alias("card"))
    return flat_cards(many.unionByName(alone).select((F.col("set_pos").cast("long") * 1_000_000_000 + F.col("card_pos")).alias("pos"), "card"))


def flat_cards(cards: DataFrame) -> DataFrame:
    """The fields of cards, given as (pos, card); what isn't there is null, names and texts are then empty."""

    def english(field: str) -> Column:
        raw = F.get_json_object("card", f"$.{field}")
        return F.coalesce(F.when(raw.startswith("{"), F.get_json_object(raw, "$.en")).otherwise(raw), F.lit(""))

    def number(field: str) -> Column:
        """A JSON number loses its fraction, a number 0 is dropped, a string stays."""
        raw = F.coalesce(F.get_json_object("card", f"$.attributes.{field}"), F.get_json_object("card", f"$.{field}"), F.get_json_object("card", f"$.{field.capitalize()}"))
        quoted = F.regexp_extract("card", rf'(?i)"{field}"\s*:\s*(")', 1) != ""
        return F.when(quoted, raw).otherwise(F.nullif(F.floor(raw.try_cast("double")).cast("string"), F.lit("0")))

    first = lambda *fields: F.coalesce(*[F.nullif(F.get_json_object("card", f"$.{f}"), F.lit("")) for f in fields])
    return cards.select(
        "pos",
        first("id", "code").alias("card_id"),
        F.coalesce(F.nullif(english("name"), F.lit("")), english("Name")).alias("name_en"),
        F.coalesce(F.nullif(english("text"), F.lit("")), english("Text")).alias("text_en"),
        first("type", "Type", "Primary").alias("card_type"),
        first("set", "Set").alias("card_set"),
        number("prowess").alias("prowess"),
        number("body").alias("body"),
        F.get_json_object("card", "$.attributes.race").alias("race"),
    )


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Flat cards of JSON files of any size; ``pos`` follows the order of files and of cards within one."""
    return flat_cards(split_cards(spark, path))


def cached_cards(spark: SparkSession, source: str, kept: str) -> DataFrame:
    """Cards from the kept copy if there is one, else from the source, which is then kept."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(kept)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        read_cards(spark, source).write.parquet(kept)
    return spark.read.parquet(kept)


def read_character_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV with a header that have a name; all columns are strings, ``pos`` is their order."""
    return spark.read.csv(path, header=True).filter(F.length("name") > 0).withColumn("pos", F.monotonically_increasing_id())


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines; comments and blank lines are left out."""
    # Quotes within a literal are escaped, so the last one ends it; a greedy run takes no stack, however long a literal is.
    term = r'(?s)^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'
    part = lambda i: F.regexp_extract(column, term, i)
    some = lambda c: F.when(c != "", c)
    is_iri = F.col(column).rlike(r"^\s*<[^>]*>\s+<[^>]*>\s+<")
    raw = part(4)
    marked = F.replace(raw, F.lit("\\\\"), F.lit("\u0000"))
    for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        marked = F.replace(marked, F.lit(code), F.lit(char))
    literal = F.replace(marked, F.lit("\u0000"), F.lit("\\"))
    return lines.filter(F.col(column).rlike(term)).select(
        part(1).alias("s"), part(2).alias("p"), F.when(is_iri, part(3)).otherwise(literal).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("o_kind"),
        some(part(5)).alias("o_dt"), some(part(6)).alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """A saved graph; files are split by line."""
    return parse_ntriples(spark.read.text(path)).select(*TRIPLE_COLUMNS)


def page_links(pages: DataFrame, column: str = "html") -> DataFrame:
    """(title, pos, url): external addresses in links of pages."""
    urls = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r'href="(https?://[^"]*)"'), 1)
    return pages.select("title", F.posexplode(urls).alias("pos", "url"))
