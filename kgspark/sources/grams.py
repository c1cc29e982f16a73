"""An inverted index of the labels of a saved graph, by runs of three characters.

Each layer that adds labels has an index of its own beside it, so an insert indexes only what it
adds, and branches share what they have in common. An index holds postings (gram, label id) in
buckets by first character, sorted by gram within each task's file; the number of labels of each gram; and
the labels themselves in slots by id. Postings are written by the task that holds their labels and never shuffled. A search reads the postings of its term's rarest grams, then the slots
of what they have in common, and looks at those labels. Equal ids of different labels only cost a look.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.model import LABEL, TRIPLE_COLUMNS
from kgspark.sources.store import ADDED, GONE, _file, _rows, _union, manifest

#: Buckets of postings. The first character decides, so grams that begin as a short term does lie together.
BUCKETS = 16
#: Postings of this many of a term's grams are read; what they leave is looked at.
RAREST = 3
#: Characters of the labels whose postings one task sorts, in memory, and writes as files of its own.
TASK_CHARS = 8_000_000


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case, and the shorter ones at its end."""
    at = lambda chars, i: F.coalesce(F.get(chars, i), F.lit(""))
    runs = lambda chars: F.transform(chars, lambda c, i: F.concat(c, at(chars, i + 1), at(chars, i + 2)))
    # The characters are bound once, as the element of an array; named directly, they would be split again for each place.
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(F.lower(text), "")), runs)))


def _bucket(first: Column) -> Column:
    return F.pmod(F.xxhash64(first), F.lit(BUCKETS)).cast("int")


def _place(layer: dict) -> str:
    return f"{layer['folder']}-grams"


def _state(spark: SparkSession, layer: dict) -> dict | None:
    files, where = _file(spark, f"{_place(layer)}/index.json")
    return json.loads(spark.read.text(str(where), wholetext=True).first()[0]) if files.exists(where) else None


def _index(spark: SparkSession, layer: dict, slot_rows: int) -> None:
    place, data = _place(layer), uuid.uuid4().hex
    rows = _rows(spark, layer, [LABEL]).select(*TRIPLE_COLUMNS).filter("length(o) > 0").withColumn("id", F.hash("o").cast("long"))
    n = rows.agg(F.count("*").alias("rows"), F.sum(F.length("o")).alias("chars")).first()
    slots = max(1, math.ceil(n.rows / slot_rows))
    slot = F.pmod(F.col("id"), F.lit(slots)).cast("int")
    rows.withColumn("slot", slot).repartition(slots, "slot").sortWithinPartitions("slot", "id").write.partitionBy("slot").parquet(f"{place}/{data}/labels")
    # The tasks hold whole labels, so a gram that most labels hold is split over all of them.
    dealt = rows.select("id", "o").repartition(max(1, math.ceil((n.chars or 0) / TASK_CHARS)), "id").dropDuplicates(["id", "o"])
    posted = dealt.select("id", F.explode(_grams(F.col("o"))).alias("gram")).withColumn("bucket", _bucket(F.substring("gram", 1, 1)))
    posted.sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{place}/{data}/postings")
    written = spark.read.schema("gram string, id long, bucket int").parquet(f"{place}/{data}/postings")
    counts = written.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{place}/{data}/counts")
    files, draft = _file(spark, f"{place}/.{data}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps({"data": data, "slots": slots}).encode()))
    stream.close()
    if not files.rename(draft, _file(spark, f"{place}/index.json")[1]):
        files.delete(draft, False)  # another writer was faster; its index holds the same


def index_labels(spark: SparkSession, path: str, slot_rows: int = 1_000_000) -> int:
    """Index the labels of the layers of a saved graph that have no index yet; returns how many were indexed.

    ``slot_rows``: labels in one slot, the least that a search reads of them. Empty labels are in no index.
    """
    due = [x for x in manifest(spark, path)["layers"] if x["kind"] == ADDED and LABEL in x["predicates"] and _state(spark, x) is None]
    for layer in due:
        _index(spark, layer, slot_rows)
    return len(due)


def _ids(spark: SparkSession, data: str, term: str) -> DataFrame | None:
    """The ids of labels that may hold a term; None where a gram of the term is in no label."""
    posted = spark.read.schema("gram string, id long, bucket int").parquet(f"{data}/postings")
    in_buckets = lambda own: F.col("bucket").isin(*[_bucket(F.lit(c)) for c in dict.fromkeys(g[0] for g in own)])  # noqa: E731  # constants, so they prune folders
    wanted = list(dict.fromkeys(term[i : i + 3] for i in range(len(term) - 2))) or [term]
    if len(term) < 3:  # every place of a label begins a gram
        return posted.filter(in_buckets(wanted)).filter(F.col("gram").startswith(term)).select("id").distinct()
    counts = spark.read.schema("gram string, n long, bucket int").parquet(f"{data}/counts")
    n = {r.gram: r.n for r in counts.filter(in_buckets(wanted)).filter(F.col("gram").isin(wanted)).collect()}  # as many rows as the term has grams
    if len(n) < len(wanted):
        return None
    rarest = sorted(wanted, key=lambda g: (n[g], g))[:RAREST]
    met = posted.filter(in_buckets(rarest)).filter(F.col("gram").isin(rarest))
    # Of labels with equal ids one may hold one gram and another the next: they are looked at.
    return met.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rarest)).select("id")


def labels_with(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The label triples of a saved graph, as it is now, that contain a term in any case; a layer without an index is scanned.

    An empty term is in every label.
    """
    layers, term = manifest(spark, path)["layers"], term.lower()
    held = F.lower("o").contains(term)
    parts = []
    for layer in [x for x in layers if x["kind"] == ADDED and LABEL in x["predicates"]]:
        state = _state(spark, layer) if term else None
        if state is None:
            parts.append(_rows(spark, layer, [LABEL]).filter(held))
            continue
        data = f"{_place(layer)}/{state['data']}"
        ids = _ids(spark, data, term)
        if ids is not None:
            rows = spark.read.schema(", ".join(f"{c} string" for c in TRIPLE_COLUMNS) + ", id long, slot int").parquet(f"{data}/labels")
            ids = ids.select(F.col("id").alias("found"), F.pmod("id", F.lit(state["slots"])).cast("int").alias("in_slot"))
            rows = rows.join(ids, (F.col("slot") == F.col("in_slot")) & (F.col("id") == F.col("found"))).filter(held)
            parts.append(rows.select(*TRIPLE_COLUMNS, F.lit(layer["seq"]).alias("seq")))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in TRIPLE_COLUMNS))
    rows, gone = _union(parts), [x for x in layers if x["kind"] == GONE and LABEL in x["predicates"]]
    if gone:
        lost = _union([_rows(spark, x, [LABEL]) for x in gone]).filter(held).select(*[F.col(c).alias(f"_{c}") for c in TRIPLE_COLUMNS], F.col("seq").alias("at"))
        same = F.col("seq") < F.col("at")
        for c in TRIPLE_COLUMNS:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = rows.join(lost, same, "left_anti")
    return rows.select(*TRIPLE_COLUMNS)
