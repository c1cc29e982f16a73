"""Removal of benchmark passages: token windows of documents against a broadcast hash set of benchmark n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import discard, mix64, slices_by_bytes, stored, text_or_empty, utf8_of
from kgspark.llm.minhash import BASE, powers

#: What each byte becomes: letters A-Z lower-cased, digits, a-z and all bytes of longer code points as they are, the rest a space.
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)

#: Documents are scanned in slices of about so many bytes, which bounds a task's memory to some 60 times as much.
SLICE_BYTES = 1 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, where words begin and end in them, and the number of each document's first word."""
    normal = _NORMAL[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = normal != 32
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    seams = offsets[1:-1]
    both = seams[inside[seams] & inside[seams + 1]]  # a document's end also ends a word
    first[both] = last[both] = True
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return normal, first, last, np.searchsorted(first, offsets)


def _word_hashes(normal: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    up, down = powers(len(normal) + 1)
    sums = np.zeros(len(normal) + 1, np.uint64)
    np.cumsum(normal.astype(np.uint64) * up[: len(normal)], out=sums[1:])
    return mix64((sums[last] - sums[first]) * down[first])


def _window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words that begin at each word."""
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        runs += words[j : j + len(runs)] * np.uint64(pow(int(BASE), 2 * j + 3, 1 << 64))
    return mix64(runs)


def _batches_by_bytes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8_of(column)
    for a, b in slices_by_bytes(offsets, SLICE_BYTES):
        own = offsets[a : b + 1]
        yield a, b, data[own[0] : own[-1]], own - own[0]


def benchmark_windows(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (gram, words, item): each run of ``width`` consecutive words of an item, or all words of a shorter one.

    Words are joined by single spaces, items are written as strings; a null id is an item of its
    own, written as the empty string. Null and wordless texts have no window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            for a, b, data, offsets in _batches_by_bytes(batch.column(1)):
                normal, first, last, begins = _words(data, offsets)
                for i, x, y in zip(range(a, b), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    n = min(width, y - x)
                    text = [bytes(normal[first[k] : last[k]]) for k in range(x, y)]
                    for at in range(0, y - x - n + 1 if n else 0, 65_536):
                        grams = [b" ".join(text[k : k + n]).decode() for k in range(at, min(at + 65_536, y - x - n + 1))]
                        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array([n] * len(grams), pa.int32()), pa.array([items[i]] * len(grams), pa.string())], ["gram", "words", "item"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "gram string, words int, item string").distinct()


class _Grams:
    """Sorted hashes of all windows by their number of words, and the items of each exact window."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.items: dict[bytes, list[str]] = {}
        widths: dict[int, set[bytes]] = {}
        for gram, n, item in rows:
            key = gram.encode()
            self.items.setdefault(key, []).append(item)
            widths.setdefault(n, set()).add(key)
        self.hashes = {}
        for n, keys in widths.items():
            data = np.frombuffer(b"".join(keys), np.uint8)
            offsets = np.cumsum([0, *map(len, keys)])
            normal, first, last, begins = _words(data, offsets)
            self.hashes[n] = np.unique(_window_hashes(_word_hashes(normal, first, last), n)[begins[:-1]])

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
        """Words of each document, the hit windows as (first word, past word, first byte, past byte), and their items."""
        normal, first, last, begins = _words(data, offsets)
        words = _word_hashes(normal, first, last)
        found: list[tuple[int, int]] = []
        for n, known in self.hashes.items():
            runs = _window_hashes(words, n)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, runs), len(known) - 1)] == runs)
            found += [(k, k + n) for k in at.tolist()]
        found.sort()
        docs = np.searchsorted(begins, [k for k, _ in found], side="right") - 1 if found else ()
        own: dict[int, tuple[list, set]] = {}
        for (k, past), doc in zip(found, docs, strict=True):
            if past > begins[doc + 1]:
                continue  # it reaches into the next document
            span = normal[first[k] : last[past - 1]].tobytes()
            if items := self.items.get(b" ".join(span.split(b" ")) if b"  " not in span else b" ".join(span.split())):
                spans, names = own.setdefault(int(doc), ([], set()))
                spans.append((k - int(begins[doc]), past - int(begins[doc]), int(first[k] - offsets[doc]), int(last[past - 1] - offsets[doc])))
                names.update(items)
        for doc, n in enumerate(np.diff(begins).tolist()):
            yield n, *own.get(doc, ([], set()))


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping and adjoining runs of words as one."""
    out: list[list[int]] = []
    for a, b, x, y in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, y
        else:
            out.append([a, b, x, y])
    return [tuple(s) for s in out]


_SPANS = "array<struct<first:int,past:int,first_byte:bigint,past_byte:bigint>>"


def _scan(docs: DataFrame, shared: Broadcast, text_col: str) -> DataFrame:
    """``docs`` with the hits of one broadcast set added to its columns n_words, spans and items, its last three."""
    fields = docs.columns
    at, kind = fields.index(text_col), pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("first_byte", pa.int64()), ("past_byte", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: _Grams | None = None
        for batch in batches:
            grams = grams or _Grams(shared.value)
            old_spans, old_items = batch.column(len(fields) - 2), batch.column(len(fields) - 1)
            for a, b, data, offsets in _batches_by_bytes(batch.column(at)):
                counts, spans, items = [], [], []
                for i, (n, new, names) in zip(range(a, b), grams.hits(data, offsets), strict=True):
                    counts.append(n)
                    before = [tuple(s.values()) for s in old_spans[i].as_py()]
                    spans.append([dict(zip(("first", "past", "first_byte", "past_byte"), s, strict=True)) for s in _merged(before + new)] if new else old_spans[i].as_py())
                    items.append(sorted({*old_items[i].as_py(), *names}) if names else old_items[i].as_py())
                kept = [batch.column(k).slice(a, b - a) for k in range(len(fields) - 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], fields)

    return docs.mapInArrow(run, docs.schema)


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    slice_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document with the spans of its words that benchmark windows cover.

    Columns: id, text (null stays null), n_words, spans (first and past word, first and past
    UTF-8 byte; disjoint, in order), items (ids of the items of which a window occurs, as sorted
    strings). Words are maximal runs of letters, digits and anything beyond ASCII, A-Z lower-cased.

    The windows of the benchmark are broadcast as a hash set, of which every hit is held against
    the window's exact words. What is broadcast is bounded: the distinct windows are measured
    first, and dealt by hash into as many slices of about ``slice_bytes`` as they need; each
    slice is sent in turn, and the documents, with the hits so far, are stored between slices.
    So any size of benchmark gives whole results; documents are never shuffled.

    Null texts have no words; empty texts no spans; repeated rows and null ids get a row each; a
    very long text is scanned whole, at some 60 bytes of memory a byte; items that share a text
    are all named; with an empty benchmark nothing is hit; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    grams = stored(benchmark_windows(benchmark, width, item_id_col, item_text_col))
    total = grams.agg(F.sum(F.octet_length("gram") * 2 + F.octet_length("item") + 64)).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    held = None
    for k in range(slices):
        own = grams.filter(F.pmod(F.xxhash64("gram", "item"), F.lit(slices)) == k) if slices > 1 else grams
        rows = _scan(rows, spark.sparkContext.broadcast([tuple(r) for r in own.collect()]), "text")  # bounded by slice_bytes
        if k < slices - 1:
            before, held = held, stored(rows)
            rows = held
            if before is not None:
                discard(before)
    discard(grams)
    return rows.withColumnRenamed("doc_id", id_col).withColumnRenamed("text", text_col) if (id_col, text_col) != ("doc_id", "text") else rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole_documents: bool = False, **options) -> DataFrame:
    """Documents without what the benchmark covers: without the spans, or without the documents that have any.

    Takes the options of ``contaminated_spans``, and treats odd rows like it. Returns id, text,
    n_hit (words removed, or that would have been). Removed spans leave what stood around them,
    white space and marks included; a null text stays null.
    """
    hits = contaminated_spans(docs, benchmark, **options)
    text_col = options.get("text_col", "text")
    n_hit = hit_words(F.col("spans"))
    if whole_documents:
        return hits.filter(F.size("spans") == 0).select(options.get("id_col", "doc_id"), text_col, n_hit.alias("n_hit"))
    raw = F.col(text_col).cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.past_byte"))
    ends = F.concat(F.col("spans.first_byte"), F.array(F.octet_length(text_col).cast("long")))
    pieces = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    left = F.when(F.size("spans") == 0, F.col(text_col)).otherwise(F.aggregate(pieces, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p)).cast("string"))
    return hits.select(options.get("id_col", "doc_id"), left.alias(text_col), n_hit.alias("n_hit"))


def hit_words(spans):
    """Number of words that disjoint spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["past"] - s["first"])
