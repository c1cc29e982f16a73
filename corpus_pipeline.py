"""From raw documents to packed training windows: quality, shared lines, near-duplicates, mixing, packing.

Stages read the five columns of documents and drop others; of an empty table each makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import stored
from kgspark.llm.lines import remove_shared_lines
from kgspark.llm.minhash import near_duplicates
from kgspark.llm.mixing import mix_sources
from kgspark.llm.packing import pack_documents
from kgspark.llm.quality import fit_quality, score_quality
from kgspark.llm.queries import table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; a null or empty text scores as the share of good labels among those learned."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, carry=COLUMNS[1:])
    return scored.filter("score >= 0.5").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows without the lines that ten or more sources share; n_chars follows the text, and both stay null for a null text."""
    return remove_shared_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component at a similarity of 0.8: that of smallest id, nulls last.

    Rows are told apart by a key of their own, so copies that share an id or have none go too.
    """
    keyed = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")))
    members = near_duplicates(keyed, id_col="row_key").select("row_key", "component_id").join(keyed.select("row_key", "doc_id"), "row_key")
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("least")).select("least.row_key")
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it; null ids and repeated rows are rows like others, a null source is one of its own."""
    keyed = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")))
    taken = mix_sources(keyed, carry=("row_key",)).filter("copies > 0").select("row_key", "copies")
    copies = keyed.join(taken, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 tokens over all rows of the mix, null texts as empty ones; columns other than id and text are ignored."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # the classifier, MinHash and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
