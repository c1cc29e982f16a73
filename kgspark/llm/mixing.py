"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import SPACE, checkpointed, text_or_empty


def word_count(text_col: str):
    """Number of maximal runs of characters other than ASCII white space; null counts as empty."""
    return F.regexp_count(text_or_empty(text_col), F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Targets of sources by weight, none above ``most`` times its size.

    ``sizes`` has source and source_size, one row per source. Sources take the weights in turn,
    in code point order, null last. The whole of all sizes is shared out; what a capped source
    leaves is shared among the rest by weight. With sources in order of cap per weight, the
    capped ones are a prefix, so one running sum finds the common rate of the others.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    by_rate = W.orderBy(most * F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_rate.rowsBetween(W.unboundedPreceding, -1)
    onward = by_rate.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rated = ranked.select(
        "*",
        F.row_number().over(by_rate).alias("place"),
        ((F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)).alias("rate"),
    ).withColumn("capped", F.col("rate") >= most * F.col("source_size") / F.col("weight"))
    common = F.min(F.when(~F.col("capped"), F.struct("place", "rate"))).over(everything)["rate"]
    return rated.select(
        "source", "source_size", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(common * F.col("weight")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Copies of each document so that every source comes near its target number of words.

    Within a source all documents expect the same number of copies, target / source size. In
    order of (size, id) the running sum of that number, moved by one offset drawn from the
    source's name and ``seed``, emits a document once for each integer it passes. The order by
    size bounds a source's error by about the size of its longest document. The running sum is
    a rank times a constant, and ranks come from a range partitioning plus one offset for each
    (partition, source), so a source that holds most rows is spread over all partitions.

    Returns one row per input row: id, the columns of ``carry``, size, source_size, target,
    copies. Null text has size 0; null sources form a source of their own, last in order; a null
    id sorts first. Rows that agree in id and size take consecutive ranks in no particular
    order. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.struct(F.col(id_col), *[F.col(c) for c in carry]).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
    )
    dealt = checkpointed(rows.repartitionByRange("source", "size", "id").withColumn("part", F.spark_partition_id()))

    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 13)
    targets = targets.withColumn("offset", F.conv(digits, 16, 10).cast("double") / float(1 << 52))

    rank = F.col("before") + F.row_number().over(W.partitionBy("part", "source").orderBy("size", "id"))
    placed = (
        dealt.alias("d")
        .join(parts.alias("p"), F.expr("d.part = p.part AND d.source <=> p.source"))
        .join(targets.alias("t"), F.expr("d.source <=> t.source"))
        .select("d.*", "p.before", "t.source_size", "t.target", "t.offset")
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("rank", rank).withColumn("each", each)
    passed = F.floor(F.col("rank") * F.col("each") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("each") + F.col("offset"))
    return placed.select("row.*", "size", "source_size", "target", F.least(passed, F.ceil("each")).cast("long").alias("copies"))
