"""Helpers shared by the corpus operators: checkpoints, whitespace rules, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that all contracts of this package share, as a Java/RE2 class body.
SPACE = r"\x20\x09-\x0D"


#: Spark's own setting that removes the shuffle files of an execution once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where nothing is set, a fresh temporary one.

    On a cluster executors don't share a temporary folder, so there a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions in this block leave no shuffle files: their results are in the shared folder."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, but as Parquet in the same folder: smaller, and columns are read apart."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_or_empty(name: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def is_training_row(id_col: str) -> Column:
    """True for rows whose label may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(~is_held_out(id_col), F.lit(False))


def is_held_out(id_col: str) -> Column:
    """True where crc32 of the id as text, mod 3, is 1. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, without a copy, and its offsets (nulls: empty)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    dtype = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices_by_bytes(offsets: np.ndarray, most: int):
    """Row ranges (first, past) of about ``most`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        past = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        past = min(n, max(past, first + 1))
        yield first, past
        first = past


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), for uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

