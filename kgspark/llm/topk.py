"""Exact top-k inner-product search by ball trees over shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import checkpointed


#: The least long: as a floor it rules nothing out.
LEAST = -(1 << 63)


class BallTree:
    """A ball tree over integer vectors; leaves hold up to ``leaf`` rows."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        self.points = points
        self.order = np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, float, int, int, int]] = []  # centre, radius, first, past, right child (0: a leaf)
        self._grow(0, len(points), leaf)

    def _grow(self, first: int, past: int, leaf: int) -> None:
        stack = [(first, past, -1)]
        while stack:
            first, past, parent = stack.pop()
            own = self.points[self.order[first:past]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            at = len(self.nodes)
            if parent >= 0:
                c, r, a, b, _ = self.nodes[parent]
                self.nodes[parent] = (c, r, a, b, at)
            self.nodes.append((centre, float(away.max()), first, past, 0))
            if past - first > leaf and away.max() > 0:
                one = own[away.argmax()]
                two = own[((own - one) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (two - one), kind="stable")
                self.order[first:past] = self.order[first:past][side]
                middle = (first + past) // 2
                stack += [(middle, past, at), (first, middle, -1)]  # the left child is the next node

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each node, no less than any inner product of the query with a row below it."""
        if not hasattr(self, "centres"):
            self.centres = np.array([n[0] for n in self.nodes])
            self.radii = np.array([n[1] for n in self.nodes])
            self.longest = float(np.sqrt((self.points**2).sum(axis=1).max()))
        length = float(np.sqrt(query @ query))
        value = self.centres @ query + length * self.radii
        value = value + 1e-9 * (np.abs(self.centres) @ np.abs(query) + length * self.radii) + 1e-6  # rounding
        return np.where(np.isfinite(value), value, np.inf)  # squares past the range of doubles rule nothing out

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where no partial sum can pass 2**53, else in Python integers held to the range of long."""
        own = self.points[rows]
        if float(np.sqrt(query @ query)) * self.longest < 2**52:
            return own @ query
        numbers = [int(x) for x in query]
        exact = (sum(int(a) * b for a, b in zip(row, numbers, strict=True)) for row in own)
        return np.array([max(LEAST, min(-LEAST - 1, x)) for x in exact], object)

    def search(self, query: np.ndarray, me: int, ids: np.ndarray, k: int, floor: int) -> list[tuple[float, int]]:
        """The k best (score, -id) of at least ``floor``, best bounds first, leaving out the row of id ``me``."""
        bounds = self.bounds(query)
        best: list[tuple[float, int]] = []
        frontier = [(-bounds[0], 0)]
        while frontier:
            bound, at = heapq.heappop(frontier)
            if -bound < floor:
                break
            _, _, first, past, right = self.nodes[at]
            if right:
                for child in (at + 1, right):
                    if bounds[child] >= floor:
                        heapq.heappush(frontier, (-bounds[child], child))
                continue
            rows = self.order[first:past]
            scores = self.scores(rows, query)
            for score, other in zip(scores[scores >= floor].tolist(), ids[rows[scores >= floor]].tolist(), strict=True):
                if other != me:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (score, -other))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, dim): floor(scale * x) of each component as double, for vectors without null or non-finite components."""
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * float(scale)
    fine = fine & F.forall(vector_col, lambda x: F.abs(scaled(x)) < float("inf"))
    # Doubles from 2**52 on are whole already and may not fit the integer type of floor.
    v = F.transform(vector_col, lambda x: F.when(F.abs(scaled(x)) < float(2**52), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return vectors.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = 16_384, query_rows: int = 2_048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query with all other rows, exactly.

    Queries are the rows whose id is divisible by ``every``; components are floor(scale * x).
    Rows are dealt by a hash of their id to shards of about ``shard_rows``, queries to blocks of
    about ``query_rows``, and each task builds one shard's ball tree and searches it for one
    block: nodes in order of their upper bound, until none reaches the query's current k-th
    score. First each query searches one shard; the k-th scores found there are shared as the
    floor for all other shards, so most of their nodes are cut off at once.

    Returns query_id, rank (from 1), vec_id, score; equal scores go by the smaller id; a query
    with fewer than k other rows gets all of them. Only vectors of one length are compared.
    Vectors that are null or empty or hold null or non-finite components take no part, nor do
    null ids; rows that share an id are candidates each, but not for their own id's queries.
    Scores are exact at any size; one that no long holds counts as the nearest long. A component that leaves the range of doubles when scaled counts as non-finite. Other
    columns, whatever their names, are ignored. An empty table gives no rows.
    """
    rows = checkpointed(quantised(vectors, id_col, vector_col, scale))
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    queries = rows.filter(F.col("id") % every == 0).select("id", "v", "dim", home.alias("home"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    candidates = rows.select("id", "v", "dim", home.alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(own) and len(asked):
            with np.errstate(over="ignore", invalid="ignore"):
                tree, ids = BallTree(np.stack(own["v"].to_numpy())), own["id"].to_numpy()
                for query, v, floor in zip(asked["query"], asked["q"], asked["floor"], strict=True):
                    found += [(query, -other, int(score)) for score, other in tree.search(np.asarray(v), query, ids, k, floor)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    schema = "query_id long, vec_id long, score long"

    def run(asked: DataFrame) -> DataFrame:
        asked = asked.select(F.col("id").alias("query"), F.col("v").alias("q"), F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), F.col("block").alias("q_block"), "floor")
        return candidates.groupBy("dim", "shard", "block").cogroup(asked.groupBy("q_dim", "q_shard", "q_block")).applyInPandas(search, schema)

    at_home = queries.select("id", "v", "dim", "block", F.col("home").alias("shard"), F.lit(LEAST).alias("floor"))
    first = checkpointed(run(at_home))
    floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    away = (
        queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST)))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
        .select("id", "v", "dim", "block", "shard", "floor")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(run(away)).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
