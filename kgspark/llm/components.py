"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches, as (node, component), for nodes with an edge.

    ``edges`` has long columns a and b; direction, repeats and loops don't matter. Each round
    points the neighbours of a node at the least of them, first the larger neighbours, then the
    smaller ones (the star method of Kiveris and others, 2014), until every node points at its
    component's least. No neighbour list is gathered: a round is two aggregations and two joins.
    Least neighbours are stored before they are joined, so both sides of a join are plain
    exchanges and Spark may split the partition of a hub. What a round has stored goes with it.
    """
    state, before = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:  # the method settles in logarithmically many rounds
        both = _turned(state, F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")))
        large = state.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = stored(large.distinct())
        smallest = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(smallest, "a")
        after = stored(_turned(small, F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        discard(state, least, large, smallest)
        state = after
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return _turned(state, F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now


def _turned(df: DataFrame, *rows: Column) -> DataFrame:
    """One row for each struct, from one pass over ``df``."""
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
