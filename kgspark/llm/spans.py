"""Removal of repeated runs of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import checkpointed, discard, stored, text_or_empty

_BREAK = re.compile(r"[.!?]+[\x20\x09-\x0D]+|[\n\r]+|[\x20\x09-\x0D](?=[A-ZÀ-ÖØ-Þ])")


def sentences(text: str) -> list[str]:
    """The sentences of a text; joined they are the whole text.

    A sentence ends after closing marks and white space, with a line, or before a word with a
    capital, so a passage put in the middle of a sentence still begins one.
    """
    cuts = [0, *[m.end() for m in _BREAK.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def runs(parts: list[str], several: int, words: int, alone: int) -> Iterator[tuple[int, int, bytes]]:
    """(first, past, 128-bit hash) of the shortest runs that begin and that end at each sentence.

    A run has ``several`` sentences and ``words`` words, or ``alone`` words, at least. What is added
    to a run leaves it one, so every sentence of a repeated passage that is long enough lies in the
    shortest run from its own place or, near the end, in the shortest run that ends the passage.
    White space within and between sentences doesn't count.
    """
    own = [(i, len(split), " ".join(split)) for i, split in enumerate(p.split() for p in parts) if split]
    first, n = 0, 0

    def run(a: int, b: int) -> tuple[int, int, bytes]:
        return own[a][0], own[b][0] + 1, xxhash.xxh3_128_digest("\n".join([s for _, _, s in own[a : b + 1]]))

    for last, (_, count, _) in enumerate(own):
        n += count
        begun = first
        while first <= last and (n >= alone or last - first + 1 >= several and n >= words):
            yield run(first, last)
            n -= own[first][1]
            first += 1
        if first == begun and first:  # no run that begins at a sentence ends here
            yield run(first - 1, last)


def remove_repeated_spans(docs: DataFrame, several: int = 2, words: int = 12, alone: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns, the text without repeated spans, plus n_sentences and n_removed.

    The shortest runs that begin and that end at each sentence of each document are hashed, and equal
    hashes meet in one aggregation over the corpus. The first place of a run, by id and then by
    place in the document, stays; every sentence that any other place of it covers goes. Runs
    repeated within a document are settled in its own task, so each document sends a hash once.
    Partial counts keep a common run cheap, and Spark splits its partition in the join back.

    Ids may have any type with an order; a null id comes last. Documents of one id, or of none, that
    differ in text are documents each, in the order of a hash of their texts; rows that agree in
    id and text count as one document and are treated alike. Null text stays null, without
    sentences; an empty text has none; a very long text is split by the task that reads it, with a
    row for each run. An empty table gives no rows; input columns called n_sentences or n_removed
    are replaced, others keep their names and values. A document whose text is wholly removed
    stays as an empty text.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    order = F.col(id_col).alias("doc")
    print_ = F.xxhash64(text_or_empty(text_col)).alias("print")
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "print")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            digests = []
            for k, text in enumerate(batch.column(2)):
                seen = set()
                for first, past, digest in runs(sentences(text.as_py()), several, words, alone):
                    again = digest in seen
                    seen.add(digest)
                    for column, value in zip(rows, (k, first, past, again), strict=True):
                        column.append(value)
                    digests.append(digest)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.bool_()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["doc", "print", "first", "past", "again", "h1", "h2"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    spans = docs.select(order, print_, text_or_empty(text_col)).mapInArrow(hashed, f"doc {kind}, print long, first int, past int, again boolean, h1 long, h2 long")
    spans = stored(spans)
    repeated = stored(spans.groupBy("h1", "h2").agg(F.count("*").alias("places"), F.min(place).alias("home")).filter("places > 1").drop("places"))
    elsewhere = spans.join(repeated, ["h1", "h2"]).filter(F.col("again") | (place > F.col("home")))
    gone = checkpointed(elsewhere.groupBy("doc", "print").agg(F.collect_set(F.struct("first", "past")).alias("gone")))
    discard(spans, repeated)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, spans_ in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                parts = sentences(text or "")
                out = np.zeros(len(parts) + 1, np.int64)
                for span in spans_.as_py() or ():
                    out[span["first"]] += 1
                    out[span["past"]] -= 1
                covered = np.cumsum(out)[:-1] > 0
                totals.append(len(parts))
                removed.append(int(covered.sum()))
                texts.append(text if not covered.any() else "".join(p for p, c in zip(parts, covered, strict=True) if not c))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), *batch.columns[2:]], ["kept_text", "n_sentences", "n_removed", *batch.schema.names[2:]])

    others = [c for c in names if c != text_col]
    keyed = docs.select(order, print_, *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).alias("text"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    same = keyed["doc"].eqNullSafe(gone["doc"]) & (keyed["print"] == gone["print"])
    joined = keyed.join(gone, same, "left").select("text", "gone", *[f"c{i}" for i in range(len(others))])
    done = joined.mapInArrow(rebuilt, "kept_text string, n_sentences long, n_removed long" + (f", {kinds}" if kinds else ""))
    return done.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"c{others.index(c)}").alias(c) for c in names], "n_sentences", "n_removed")
