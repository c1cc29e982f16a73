"""What each of five filters removes, alone and in every order, from a histogram of failure masks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import SPACE, text_or_empty

#: The filters in order of their bits, the lowest first.
FILTERS = "ABCDE"


def failure_mask(text: Column, least_words: int = 100, least_distinct: int = 80, most_capitals: int = 10) -> Column:
    """Bits of the four filters that a text decides alone.

    A: under ``least_words`` words. B: distinct words are under ``least_distinct`` per cent of the
    words. C: more than ``most_capitals`` per cent of the code points are A-Z. D: holds one of
    ``#$%&*|``. Words are maximal runs without ASCII white space; an empty text fails A alone.
    """
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        n < least_words,
        F.lit(100) * distinct.cast("long") < F.lit(least_distinct) * n.cast("long"),
        F.lit(100) * capitals.cast("long") > F.lit(most_capitals) * F.char_length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """At most 32 rows per part: how many documents fail exactly the filters of ``mask``.

    Columns: part, mask, n, n_good (labelled quality 1), n_toxic (labelled toxic 1). Null part
    counts as the empty string, null text as empty. The fifth bit says that a row of smaller id
    has the same text, in any part; a row without id is no smaller than any, nor larger. Repeated
    rows count each, and rows that share an id are no copies of one another. Several labels of
    an id count as one that holds if any does. Other columns, whatever their names, are ignored.

    Texts meet by their SHA-256, so no text is shuffled. Rows are first counted per (text, part,
    labels, id), which spreads a text of any number of copies over all tasks; then per text only
    counts and the least id meet, combined before each shuffle, and one row per (text, part,
    labels) is left to learn the least id of its text. A very long text costs its task the memory
    of its word list.
    """
    facts = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        failure_mask(text_or_empty(text_col)).alias("mask"),
        F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"),
    )
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    labelled = facts.join(known, facts["id"] == known["labelled"], "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    same = ["digest", "part", "mask", "good", "toxic"]
    each = labelled.select("id", "part", "mask", "digest", *flags).groupBy(*same, "id").agg(F.count("*").alias("n"))
    sets = each.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_free"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    # One text has a row here for each part and pair of labels it comes with, however many copies there are.
    least = sets.groupBy("digest").agg(F.min("first.id").alias("least"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "n_free", "first")).alias("sets"))
    by_set = least.select("least", F.explode("sets").alias("s")).select("least", "s.*")
    originals = F.col("n_free") + F.coalesce(F.when(F.col("first.id") == F.col("least"), F.col("first.n")), F.lit(0))
    split = by_set.select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - originals).alias("n")))).alias("cell")
    )
    n = F.col("cell.n")
    return (
        split.filter(n > 0)
        .groupBy("part", F.col("cell.mask").alias("mask"))
        .agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("n_toxic"))
    )


def audit_filters(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, of the table that ``mask_cells`` gives.

    In an order, each document is removed by the first filter that it fails. kept: left after the
    step; removed: by this step; redundant: fail this filter, but are gone before; unique_fails:
    fail this filter alone; good_lost and toxic_lost: labelled documents among the removed;
    shapley: the removed of this filter, summed over all orders, for which a document that fails
    k filters counts with 120 / k of the 120 orders. An empty table gives no rows.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    own = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # 32 at most
    steps = own.select("part", "cells", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    mask_of = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    placed = steps.select(
        "*",
        mask_of(F.substring("filter_order", F.col("step"), F.lit(1))).alias("bit"),
        mask_of(F.substring("filter_order", F.lit(1), F.col("step") - 1)).alias("gone"),
    )
    bit, gone = F.col("bit"), F.col("gone")

    def total(of: str, chosen, weight=lambda c: F.lit(1)) -> Column:
        return F.aggregate(F.filter("cells", chosen), F.lit(0).cast("long"), lambda acc, c: acc + c[of] * weight(c).cast("long"))

    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    before = lambda c: c["mask"].bitwiseAND(gone) != 0
    removed = lambda c: fails(c) & ~before(c)
    return placed.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda c: ~fails(c) & ~before(c)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda c: fails(c) & before(c)).alias("redundant"),
        total("n", lambda c: c["mask"] == bit).alias("unique_fails"),
        total("n_good", removed).alias("good_lost"),
        total("n_toxic", removed).alias("toxic_lost"),
        total("n", fails, lambda c: F.lit(len(orders)) / F.bit_count(c["mask"])).alias("shapley"),
    )
