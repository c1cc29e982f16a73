"""Copies of a saved graph's layers in the order of subject or object, for lookups that shuffle no triples.

A copy is bucketed by its column, in the order of the column's hash within a bucket, and holds Parquet
Bloom filters of it. A table of keys is shuffled to the buckets, or broadcast where Spark finds it small;
the triples stay where they are, and only those that a filter of fixed size calls likely are sorted. Copies belong to layers, not to graphs: an insert makes only its own layer's copy due, and
branches share what they have in common. Deletes are applied to what was found.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.model import LONG, TRIPLE_COLUMNS, checkpointed, is_long, likely, marks
from kgspark.sources.store import ADDED, GONE, _file, _rows, _union, manifest

#: (keys, column of keys, "s" or "o") -> the keys' rows, each with the triples that have it there.
Finder = Callable[[DataFrame, str, str], DataFrame]

_SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string, salt int"
#: At most this many keys of a copy are split, so what a lookup broadcasts of them stays below 2 MB.
MOST_SPLIT = 100_000
#: Bytes of a bucket, so a task sorts it in memory. Triples with objects of more characters than ``LONG``, such as texts, stay where they are.
BUCKET_BYTES = 128_000_000
#: Frequent keys are looked for in this many classes of hashes; a class of few triples holds none.
CLASSES = 1 << 14


def scan(graph: DataFrame) -> Finder:
    """Lookups by a join with all triples that may be found; the others aren't shuffled."""
    return lambda keys, key, by: likely(graph, by, keys, key).join(keys, F.col(by) == F.col(key))


def _place(layer: dict, by: str) -> str:
    return f"{layer['folder']}-by-{by}"


def _state(spark: SparkSession, place: str) -> dict | None:
    """What a finished copy says of itself; it is written last."""
    files, where = _file(spark, f"{place}/copy.json")
    return json.loads(spark.read.text(f"{place}/copy.json", wholetext=True).first()[0]) if files.exists(where) else None


def _bit(c: str) -> Column:
    """One of 64 bits for a text, so an aggregate of fixed width can say which predicates there are, and maybe others."""
    return F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({c}), 64) AS INT))")


def _frequent(rows: DataFrame, by: str, counts: DataFrame, most: int) -> DataFrame:
    """(h, parts) of the keys of more than ``most`` triples; only keys in crowded classes of hashes are counted by themselves."""
    crowded = counts.filter(F.col("n") > most).select(F.col("class").alias("_class"))
    few = rows.select(F.xxhash64(by).alias("h")).join(F.broadcast(crowded), F.pmod("h", F.lit(CLASSES)) == F.col("_class"), "left_semi")
    return few.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("h", F.ceil(F.col("n") / most).cast("int").alias("parts"))


@contextmanager
def _unsorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Bucketed files are written in the order in which rows come; otherwise Spark sorts them, by an expression that it evaluates anew at each comparison."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, 8)  # a task has the rows of one bucket
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _copy(spark: SparkSession, layer: dict, by: str, bucket_rows: int) -> dict:
    rows = _rows(spark, layer, layer["predicates"]).select(*TRIPLE_COLUMNS)
    place, data = _place(layer, by), uuid.uuid4().hex
    # A row in memory has a word for each column besides its strings.
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in TRIPLE_COLUMNS), F.lit(80))
    counts = rows.groupBy(F.pmod(F.xxhash64(by), F.lit(CLASSES)).alias("class")).agg(
        F.count_if(~is_long()).alias("n"), F.sum(F.when(~is_long(), size)).alias("bytes"), F.bit_or(F.when(is_long(), _bit("p"))).alias("long")
    )
    counts = checkpointed(counts)
    n = counts.agg(F.sum("n").alias("total"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"), F.bit_or("long").alias("long")).first()
    rows, total = rows.filter(~is_long()), n.total or 0
    buckets, most = max(1, math.ceil(total / bucket_rows), math.ceil((n.bytes or 0) / BUCKET_BYTES)), max(bucket_rows // 4, total // MOST_SPLIT, 1)
    nothing = spark.createDataFrame([], "h long, parts int")
    (_frequent(rows, by, counts, most) if (n.most or 0) > most else nothing).coalesce(1).write.parquet(f"{place}/{data}/split")
    parts = spark.read.schema("h long, parts int").parquet(f"{place}/{data}/split")
    if parts.isEmpty():
        dealt = rows.withColumn("salt", F.lit(0))
    else:
        dealt = rows.join(F.broadcast(parts), F.xxhash64(by) == F.col("h"), "left")
        dealt = dealt.select(*TRIPLE_COLUMNS, F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*TRIPLE_COLUMNS), "parts")).cast("int").alias("salt"))
    out = dealt.repartition(buckets, by, "salt").sortWithinPartitions(F.xxhash64(by)).write.bucketBy(buckets, by, "salt").format("parquet").option("compression", "zstd")
    named = spark.createDataFrame([(p,) for p in layer["predicates"]], "p string").filter(_bit("p").bitwiseAND(F.lit(n.long or 0)) != 0)
    state = {"data": data, "buckets": buckets, "predicates": layer["predicates"], "long": sorted(r.p for r in named.collect())}
    with _unsorted_buckets(spark):
        out.option(f"parquet.bloom.filter.enabled#{by}", "true").option("path", f"{place}/{data}/rows").saveAsTable(_name(place, state))
    files, draft = _file(spark, f"{place}/.{data}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if not files.rename(draft, _file(spark, f"{place}/copy.json")[1]):
        files.delete(draft, False)  # another writer was faster; its copy holds the same
    return _state(spark, place)


def _name(place: str, state: dict) -> str:
    return f"kgspark_{hashlib.md5((place + state['data']).encode()).hexdigest()}"


def _table(spark: SparkSession, place: str, state: dict, by: str) -> DataFrame:
    """A copy as a bucketed table; a session that doesn't know it yet is told where it lies."""
    name = _name(place, state)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_SCHEMA}) USING parquet CLUSTERED BY ({by}, salt) INTO {state['buckets']} BUCKETS LOCATION '{place}/{state['data']}/rows'")
    return spark.table(name)


def order(spark: SparkSession, path: str, by: tuple[str, ...] = ("s", "o"), bucket_rows: int = 500_000) -> int:
    """Copy the layers of a saved graph that have no copy yet; returns how many copies were made.

    A bucket has about ``bucket_rows`` rows, or ``BUCKET_BYTES``, at most. A key of more than a quarter of that, such as a class
    of very many instances, is split over several buckets by a hash of the whole triple. Triples whose
    objects have over ``LONG`` characters are in no copy; a lookup filters them where they are and moves only what it may find.
    """
    made = 0
    for layer in manifest(spark, path)["layers"]:
        for column in by:
            if layer["kind"] == ADDED and _state(spark, _place(layer, column)) is None:
                _copy(spark, layer, column, bucket_rows)
                made += 1
    return made


def finder(spark: SparkSession, *paths: str) -> Finder:
    """Lookups in the copies of saved graphs, as they are now; a layer without a copy is read as it lies.

    Keys keep their columns and repeats, null keys find nothing; the columns of keys must not be
    named as those of triples. Graphs are taken together as they are, without removing repeats.
    """
    held = [manifest(spark, path)["layers"] for path in paths]
    known: list[tuple[DataFrame, str, DataFrame]] = []  # keys and their filters, as lookups by subject and by object often share them

    def words_of(keys: DataFrame, key: str) -> DataFrame:
        for own, name, words in known:
            if own is keys and name == key:
                return words
        known.append((keys, key, checkpointed(marks(keys, key))))
        return known[-1][2]

    def find(keys: DataFrame, key: str, by: str) -> DataFrame:
        words = words_of(keys, key)
        found = [_found(spark, layers, keys, key, by, words) for layers in held]
        found = [x for x in found if x is not None]
        nothing = keys.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in TRIPLE_COLUMNS], "*")
        return _union(found) if found else nothing

    return find


def _found(spark: SparkSession, layers: list[dict], keys: DataFrame, key: str, by: str, words: DataFrame) -> DataFrame | None:
    own, columns = [x for x in layers if x["kind"] == ADDED], [*TRIPLE_COLUMNS, *keys.columns]
    parts = []
    for layer in own:
        place = _place(layer, by)
        state = _state(spark, place)
        if state is None:
            rows = likely(_rows(spark, layer, layer["predicates"]).drop("seq"), by, None, key, words=words).join(keys, F.col(by) == F.col(key))
        else:
            rows = _table(spark, place, state, by)
            if state["predicates"] != layer["predicates"]:  # some were dropped or rewritten since
                rows = rows.filter(F.col("p").isin(layer["predicates"]))
            split = spark.read.schema("h long, parts int").parquet(f"{place}/{state['data']}/split")
            spread = keys.join(F.broadcast(split), F.xxhash64(key) == F.col("h"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            rows = likely(rows, by, None, key, words=words).join(spread, (F.col(by) == F.col(key)) & (F.col("salt") == F.col("_salt")))
            with_long = [p for p in layer["predicates"] if p in state["long"]] if isinstance(state.get("long"), list) else layer["predicates"]  # a copy made before this list was kept has a count
            if state.get("long") and with_long:
                asked = keys.filter(F.length(key) > LONG) if by == "o" else keys
                left = likely(_rows(spark, layer, with_long).drop("seq").filter(is_long()), by, asked, key, words=None if by == "o" else words)
                parts.append(left.join(asked, F.col(by) == F.col(key)).select(*columns, F.lit(layer["seq"]).alias("_seq")))
        parts.append(rows.select(*columns, F.lit(layer["seq"]).alias("_seq")))
    if not parts:
        return None
    rows, gone = _union(parts), [x for x in layers if x["kind"] == GONE]
    if gone:
        gone = _union([_rows(spark, x, x["predicates"]) for x in gone]).select(*[F.col(c).alias(f"_{c}") for c in TRIPLE_COLUMNS], F.col("seq").alias("_at"))
        same = F.col("_seq") < F.col("_at")
        for c in TRIPLE_COLUMNS:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = rows.join(gone, same, "left_anti")
    return rows.select(*columns)


def having(spark: SparkSession, path: str, by: str, names: list[str]) -> DataFrame:
    """The triples whose subject or object is one of a few names, told to the scan, so Bloom filters and order skip the rest."""
    keys = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "_key string")
    find = finder(spark, path)
    return find(keys, "_key", by).filter(F.col(by).isin(names)).select(*TRIPLE_COLUMNS)
