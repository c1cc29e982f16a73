"""Exact deduplication by two passes over a Bloom filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import SPACE, checkpointed, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 27) -> DataFrame:
    """Group equal texts and choose one row of each group.

    Texts are equal when they agree after deleting ASCII white space. The first pass sets two
    bits per text in a counting Bloom filter of ``filter_bits`` bits (a power of two) and keeps
    the bits hit more than once. The second pass tests each row against that filter: rows that
    miss are unique and pass straight through, only the others are shuffled by their SHA-256.
    The filter has at most ``filter_bits / 64`` rows of two longs, so it may be broadcast at any
    corpus size; a crowded filter sends more rows through the shuffle but changes no result.

    Returns one row per input row: id, text_sha256, keep_id, group_size, kept. Null text counts
    as empty. Of equal texts the row with most code points stays, then the smallest id (null
    last), then one of the identical rows. An empty table gives an empty result; columns other
    than the two named are ignored.
    """
    if filter_bits < 64 or filter_bits > 1 << 31 or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two from 64 to 2**31")
    text = text_or_empty(text_col)
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.char_length(text).alias("n_chars"),
            F.unhex(F.sha2(F.regexp_replace(text, f"[{SPACE}]+", "").cast("binary"), 256)).alias("sha"),
        ).select(
            "*",
            F.xxhash64("sha").bitwiseAND(F.lit(filter_bits - 1)).alias("p"),
            F.shiftrightunsigned(F.xxhash64("sha"), 32).bitwiseAND(F.lit(filter_bits - 1)).alias("q"),
        )
    )
    again = (
        rows.select(F.explode(F.array("p", "q")).alias("bit"))
        .groupBy("bit")
        .count()
        .filter("count > 1")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    )
    probed = rows
    for at in ("p", "q"):
        words = F.broadcast(again.select(F.col("word").alias(f"{at}_word"), F.col("bits").alias(f"{at}_bits")))
        probed = probed.join(words, F.shiftright(at, 6) == F.col(f"{at}_word"), "left")
    hit = F.expr("coalesce(shiftrightunsigned(p_bits, CAST(p & 63 AS INT)) & 1 = 1 AND shiftrightunsigned(q_bits, CAST(q & 63 AS INT)) & 1 = 1, false)")
    probed = probed.select("id", "row", "n_chars", "sha", hit.alias("maybe_repeated"))

    maybe = probed.filter("maybe_repeated")
    best = F.struct((-F.col("n_chars")).alias("longest"), F.col("id").isNull().alias("no_id"), "id", "row")
    # Cut here, the join below has a plain exchange on either side and Spark may split the partition of a hot group.
    groups = checkpointed(maybe.groupBy("sha").agg(F.min(best).alias("keep"), F.count("*").alias("group_size")))
    grouped = maybe.join(groups, "sha").select(
        "id", "sha", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept")
    )
    unique = probed.filter("NOT maybe_repeated").select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    return unique.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
