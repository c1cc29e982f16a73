"""Removal of lines that many sites share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import checkpointed, stored, text_or_empty


def line_key(line: Column) -> Column:
    """128 bits of a line freed of ASCII white space at its ends; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) > 0, F.unhex(F.md5(bare.cast("binary"))))


def keyed_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(text_key, at, line, site) of the lines that aren't blank, stored: the texts are split and hashed once."""
    text = text_or_empty(text_col)
    lines = docs.select(text_key(text), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "text"))
    return stored(lines.select("text_key", "at", line_key(F.col("text")).alias("line"), "site").filter("line IS NOT NULL"))


def text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary"))).alias("text_key")


def shared_lines(lines: DataFrame, most_sites: int = 10, deviation: float = 0.05) -> DataFrame:
    """(line, sites, exact): lines that stand in documents of at least ``most_sites`` sites.

    Each line's sites go into a HyperLogLog sketch of relative deviation ``deviation``; sketches
    are merged by partial aggregation, so a line of a third of all documents costs one small
    sketch per task. Estimates of less than half the threshold are dropped and those above its
    double are taken as they are. For the rest, near the threshold, the distinct pairs of line
    and site are counted. A null site is no site.
    """
    lines = lines.select("line", "site").filter("site IS NOT NULL")
    sketched = lines.groupBy("line").agg(F.approx_count_distinct("site", deviation).alias("sites"))
    sketched = checkpointed(sketched.filter(F.col("sites") >= most_sites / 2))
    clear = sketched.filter(F.col("sites") >= 2 * most_sites).withColumn("exact", F.lit(False))
    near = sketched.filter(F.col("sites") < 2 * most_sites).select("line")
    pairs = lines.distinct().join(near, "line", "left_semi")
    counted = pairs.groupBy("line").agg(F.count("*").alias("sites")).withColumn("exact", F.lit(True))
    return clear.unionByName(counted.filter(F.col("sites") >= most_sites))


def remove_shared_lines(docs: DataFrame, most_sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All input columns, the text without the lines of ``shared_lines``, plus n_lines and n_removed.

    Every copy of a shared line goes, blank lines stay, and so do line breaks between kept lines.
    Which lines of a text go depends on the text alone, so positions are found once per distinct
    text and joined back to the rows; Spark splits hot texts and hot lines in both joins. A null
    text stays null with no lines; rows keep their number even where nothing of the text is
    left; an empty table gives no rows; input columns called n_lines or n_removed are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = keyed_lines(docs, text_col, site_col)
    shared = checkpointed(shared_lines(lines, most_sites).select("line"))
    hit = lines.select("text_key", "at", "line").join(shared, "line", "left_semi")
    gone = checkpointed(hit.groupBy("text_key").agg(F.collect_set("at").alias("gone")))
    keyed = docs.select(F.struct(*names).alias("row"), text_key(text_or_empty(text_col)))
    split = F.split(F.col(f"row.{text_col}"), "\n")
    out = keyed.join(gone, "text_key", "left").withColumn("split", F.when(F.col("gone").isNotNull(), split))
    places = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(F.transform(places, lambda i: F.get("split", i)), "\n"))
    text = F.col(f"row.{text_col}")
    return out.select(
        *[kept.alias(c) if c == text_col else F.col(f"row.{c}") for c in names],
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
