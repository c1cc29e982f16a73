"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import checkpointed, is_training_row, text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``most[label]`` training rows of each label, chosen by a hash of the id.

    Only labels of rows whose crc32(id as text) mod 3 is not 1 are read. The ids chosen are bounded
    by ``most``, so they are broadcast and the documents are read without a shuffle. Labels other
    than those named, null labels and null ids are left out; a label given twice counts once.
    """
    training = labels.filter(F.col(id_col).isNotNull() & is_training_row(id_col)).select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("label"))
    order = F.xxhash64(F.col("labelled"))
    chosen = None
    for label, n in most.items():
        own = training.filter(F.col("label") == label).orderBy(order, "labelled").limit(n)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = F.broadcast(chosen.groupBy("labelled").agg(F.max("label").alias("label")))
    found = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(chosen, F.col("id") == F.col("labelled"))
    return checkpointed(found.select("text", "label"))
