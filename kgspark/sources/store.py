"""A saved graph that takes inserts and deletes by writing only what changes.

A graph's folder holds layers of Parquet, each in folders by predicate, and numbered manifests. A
manifest is a short JSON text that names the layers in order and, for each, the predicates that
still count; readers take the last one. A change first writes its layer, then a new manifest, so
a write that breaks off leaves the graph as it was; what it left behind is in no manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.model import TRIPLE_COLUMNS, is_long, likely

_LAYER = "s string, o string, o_kind string, o_dt string, o_lang string, pred string"
ADDED, GONE = "added", "gone"


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The last manifest of a saved graph, or that of a version; a graph never saved has no layers."""
    files, folder = _file(spark, f"{path}/versions")
    if not files.exists(folder):
        return {"version": 0, "layers": []}
    known = [int(m[1]) for f in files.listStatus(folder) if (m := re.fullmatch(r"v(\d+)\.json", f.getPath().getName()))]
    version = max(known, default=0) if version is None else version
    if version == 0:
        return {"version": 0, "layers": []}
    return json.loads(spark.read.text(f"{path}/versions/v{version}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, before: dict, layers: list[dict]) -> dict:
    """Write the next manifest under another name, then rename it; of two writers at once the later one fails."""
    after = {"version": before["version"] + 1, "layers": [x for x in layers if x["predicates"]]}
    target = f"{path}/versions/v{after['version']}.json"
    files, draft = _file(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(after).encode()))
    out.close()
    _, final = _file(spark, target)
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"another writer has committed version {after['version']} of {path}")
    return after


def _write_layer(spark: SparkSession, path: str, rows: DataFrame, kind: str, seq: int) -> dict:
    """Save triples as a layer; predicates of many rows are split over tasks, small ones share one."""
    folder = f"{path}/layers/{seq}-{kind}-{uuid.uuid4().hex}"
    rows.select(*TRIPLE_COLUMNS).withColumnRenamed("p", "pred").hint("rebalance", "pred").write.partitionBy("pred").parquet(folder)
    return {"seq": seq, "kind": kind, "folder": folder, "predicates": _predicates(spark, folder)}


def _predicates(spark: SparkSession, folder: str) -> list[str]:
    """The predicates of a layer, from the names of its folders."""
    files, where = _file(spark, folder)
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted(unescape(n.removeprefix("pred=")) for n in names if n.startswith("pred="))


def _rows(spark: SparkSession, layer: dict, predicates: list[str]) -> DataFrame:
    own = [p for p in layer["predicates"] if p in predicates]
    rows = spark.read.schema(_LAYER).parquet(layer["folder"]).withColumnRenamed("pred", "p")
    return rows.filter(F.col("p").isin(own)).select(*TRIPLE_COLUMNS, F.lit(layer["seq"]).alias("seq"))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in TRIPLE_COLUMNS))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def read_store(spark: SparkSession, path: str, predicates: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The triples of a saved graph, or of some predicates, as of a version.

    A layer is read with a filter on its predicates, which prunes folders. Predicates that only
    ever grew are a plain scan; those with deletes are joined with them: a triple is gone if a
    later layer says so.
    """
    layers = manifest(spark, path, version)["layers"]
    known = sorted({p for x in layers for p in x["predicates"] if predicates is None or p in predicates})
    with_gone = {p for x in layers if x["kind"] == GONE for p in x["predicates"]}
    parts = []
    for chosen, exact in (([p for p in known if p not in with_gone], False), ([p for p in known if p in with_gone], True)):
        own = [x for x in layers if x["kind"] == ADDED and set(x["predicates"]) & set(chosen)]
        if not own:
            continue
        rows = _union([_rows(spark, x, chosen) for x in own])
        if exact:
            gone = _union([_rows(spark, x, chosen) for x in layers if x["kind"] == GONE and set(x["predicates"]) & set(chosen)])
            whole = lambda df: df.withColumn("whole", F.xxhash64(*TRIPLE_COLUMNS))
            rows, keys = whole(rows), whole(gone)
            parts.append(likely(rows, "whole", keys, "whole", rest=True).select(*TRIPLE_COLUMNS))  # as good as all that stay, without a shuffle
            rows = likely(rows, "whole", keys, "whole")
            gone = gone.select(*[F.col(c).alias(f"{c}_gone") for c in TRIPLE_COLUMNS], F.col("seq").alias("at"))
            same = [F.col(c).eqNullSafe(F.col(f"{c}_gone")) for c in TRIPLE_COLUMNS]
            for c in [*same, F.col("seq") < F.col("at")][1:]:
                same[0] = same[0] & c
            rows = rows.join(gone, same[0], "left_anti")
        parts.append(rows.select(*TRIPLE_COLUMNS))
    return _union(parts) if parts else _none(spark)


def _present(spark: SparkSession, path: str, rows: DataFrame, how: str) -> DataFrame:
    """``rows``, as a set, that the graph holds (left_semi) or lacks (left_anti); only their predicates are read.

    Long objects are compared by SHA-256, and only rows that this calls wanted are fetched by it, so texts stay where they are.
    """
    long = {r.p: r.long for r in rows.groupBy("p").agg(F.bool_or(F.coalesce(is_long(), F.lit(False))).alias("long")).collect()}  # of a vocabulary, not of the data
    held, texts_of = read_store(spark, path, list(long)), [p for p in long if long[p]]
    if not texts_of:
        return _met(rows.select(*TRIPLE_COLUMNS), held, TRIPLE_COLUMNS, how)
    digest = lambda df: df.filter(is_long()).withColumn("digest", F.sha2("o", 256))
    own, columns = digest(rows.filter(F.col("p").isin(texts_of)).select(*TRIPLE_COLUMNS)), ["digest" if c == "o" else c for c in TRIPLE_COLUMNS]
    wanted = _met(own.select(*columns), digest(read_store(spark, path, texts_of)).select(*columns), columns, how)
    whole = lambda df: df.withColumn("whole", F.xxhash64(*columns))
    keys = whole(wanted)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # An inner join with a set of keys: Spark would push a semi-join down before the filter, and so shuffle all texts.
    texts = likely(whole(own), "whole", keys, "whole").drop("whole").join(keys.select(*[F.col(c).alias(f"_{c}") for c in columns]), same).dropDuplicates(columns)
    short = lambda df: df.select(*TRIPLE_COLUMNS).filter(~F.coalesce(is_long(), F.lit(False)))
    return _met(short(rows), short(held), TRIPLE_COLUMNS, how).unionByName(texts.select(*TRIPLE_COLUMNS))


def _met(own: DataFrame, held: DataFrame, columns: list[str], how: str) -> DataFrame:
    """The rows of ``own``, as a set, that are (left_semi) or aren't (left_anti) in ``held``; one shuffle does both."""
    both = own.withColumn("own", F.lit(True)).unionByName(held.withColumn("own", F.lit(False)))
    met = both.groupBy(*columns).agg(F.bool_or("own").alias("own"), F.bool_and("own").alias("new"))
    return met.filter("own AND new" if how == "left_anti" else "own AND NOT new").select(*columns)


def insert(spark: SparkSession, path: str, triples: DataFrame, unique: bool = False) -> dict:
    """Add triples, as a set; what the graph holds already isn't written again. Returns the new manifest.

    ``unique``: the triples are known to be a set by themselves.
    """
    before = manifest(spark, path)
    rows = triples.select(*TRIPLE_COLUMNS)
    fresh = _present(spark, path, rows, "left_anti") if before["layers"] else rows if unique else rows.dropDuplicates()
    return _commit(spark, path, before, [*before["layers"], _write_layer(spark, path, fresh, ADDED, before["version"] + 1)])


def load(spark: SparkSession, path: str, parts: dict[str, DataFrame]) -> dict:
    """Begin a saved graph with sets of triples by predicate, or add them to one. Returns the new manifest.

    A set of a predicate that the graph lacks goes to its folder as it comes: triples are neither shuffled nor sorted.
    Only those of predicates that it holds are held against it, so these need not be sets.
    """
    before = manifest(spark, path)
    held = {p for x in before["layers"] for p in x["predicates"]}
    known, new = [p for p in parts if p in held], [p for p in parts if p not in held]
    folder = f"{path}/layers/{before['version'] + 1}-{ADDED}-{uuid.uuid4().hex}"
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    write = lambda p: parts[p].select(*[c for c in TRIPLE_COLUMNS if c != "p"]).write.parquet(f"{folder}/pred={escape(p)}")
    with ThreadPoolExecutor(4) as pool:  # most predicates are small, so some are written at a time
        list(pool.map(write, new))
    layers = [{"seq": before["version"] + 1, "kind": ADDED, "folder": folder, "predicates": sorted(new)}]
    if known:
        fresh = _present(spark, path, _union([parts[p].select(*TRIPLE_COLUMNS) for p in known]), "left_anti")
        layers.append(_write_layer(spark, path, fresh, ADDED, before["version"] + 1))
    return _commit(spark, path, before, [*before["layers"], *layers])


def predicates(spark: SparkSession, path: str) -> list[str]:
    """The predicates that a saved graph holds, or held before all their triples were deleted one by one."""
    return sorted({p for x in manifest(spark, path)["layers"] for p in x["predicates"]})


def remove(spark: SparkSession, path: str, triples: DataFrame) -> dict:
    """Delete triples: a layer of those that the graph holds. Returns the new manifest."""
    before = manifest(spark, path)
    gone = _present(spark, path, triples.select(*TRIPLE_COLUMNS), "left_semi")
    return _commit(spark, path, before, [*before["layers"], _write_layer(spark, path, gone, GONE, before["version"] + 1)])


def drop(spark: SparkSession, path: str, predicates: list[str] | None = None) -> dict:
    """Delete all triples of some predicates, or all: a manifest without them, and no data at all."""
    before = manifest(spark, path)
    kept = lambda x: [p for p in x["predicates"] if predicates is not None and p not in predicates]
    return _commit(spark, path, before, [x | {"predicates": kept(x)} for x in before["layers"]])


def compact(spark: SparkSession, path: str, most_layers: int = 1) -> dict:
    """Rewrite the predicates that more than ``most_layers`` layers hold as one layer; the others stay where they are."""
    before = manifest(spark, path)
    held: dict[str, int] = {}
    for x in before["layers"]:
        for p in x["predicates"]:
            held[p] = held.get(p, 0) + 1
    many = [p for p, n in held.items() if n > most_layers]
    if not many:
        return before
    layer = _write_layer(spark, path, read_store(spark, path, many), ADDED, before["version"] + 1)
    return _commit(spark, path, before, [*(x | {"predicates": [p for p in x["predicates"] if p not in many]} for x in before["layers"]), layer])


def branch(spark: SparkSession, path: str, copy: str) -> dict:
    """A graph at another path that begins as this one and shares its layers; neither changes the other's files."""
    return _commit(spark, copy, manifest(spark, copy), manifest(spark, path)["layers"])
