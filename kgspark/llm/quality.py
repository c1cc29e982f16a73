"""Document quality by votes of the nearest labelled documents in a latent space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import slices_by_bytes, text_or_empty, utf8_of
from kgspark.llm.labelled import labelled_sample
from kgspark.llm.minhash import BASE, word_hashes

N_SHAPES = 2048
N_WORDS = 2048
N_PAIRS = 2048
N_TERMS = N_SHAPES + N_WORDS + N_PAIRS + 2


def _classes() -> np.ndarray:
    """A class for each byte: letters by case (all non-ASCII as lower case), digits, space, controls, each mark its own."""
    table = np.empty(256, np.int32)
    for b in range(256):
        if b >= 128 or 97 <= b <= 122:
            table[b] = 1
        elif 65 <= b <= 90:
            table[b] = 2
        elif 48 <= b <= 57:
            table[b] = 3
        else:
            table[b] = 4 if b == 32 else 5 if b < 32 else 6 + b % 58
    return table


def term_weights(column: pa.Array) -> Iterator[np.ndarray]:
    """Square roots of term frequencies of each text.

    Terms are hashed runs of three byte classes, hashed words, hashed pairs of neighbouring words,
    and two for words: the same as the word before it, or not. Every byte of the text counts.
    """
    table = _classes()
    data, offsets = utf8_of(column)
    for first, past in slices_by_bytes(offsets, 1 << 20):
        at = offsets[first : past + 1] - offsets[first]
        own = data[offsets[first] : offsets[past]]
        kind = table[own]
        codes = (kind[:-2] * 4096 + kind[1:-1] * 64 + kind[2:]).astype(np.uint32) if len(own) > 2 else np.zeros(0, np.uint32)
        codes = (codes * np.uint32(2654435761)) >> np.uint32(21)
        words, begins = word_hashes(own, at)
        same = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
        top = np.uint64(53)  # 11 bits remain
        pairs = (words[:-1] * np.uint64(BASE) + words[1:]) * np.uint64(0x9E3779B97F4A7C15) >> top
        words = words >> top
        for a, b, v, w in zip(at[:-1], at[1:], begins[:-1], begins[1:], strict=True):
            terms = np.zeros(N_TERMS, np.float32)
            if b - a > 2:
                terms[:N_SHAPES] = np.sqrt(np.bincount(codes[a : b - 2], minlength=N_SHAPES) / (b - a - 2))
            if w > v:
                terms[N_SHAPES : N_SHAPES + N_WORDS] = np.sqrt(np.bincount(words[v:w].astype(np.int64), minlength=N_WORDS) / (w - v))
                if w - v > 1:
                    terms[N_SHAPES + N_WORDS : -2] = np.sqrt(np.bincount(pairs[v : w - 1].astype(np.int64), minlength=N_PAIRS) / (w - v - 1))
                repeats = same[v + 1 : w].sum() / (w - v)
                terms[-2:] = repeats**0.5, (1 - repeats) ** 0.5
            yield terms


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labelled: int = 4096, dimensions: int = 64, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Latent-semantic vectors of at most ``most_labelled`` labelled documents, half of them of each label.

    Terms are weighed by inverse document frequency in the sample, and the sample's leading
    singular vectors span the latent space. Returns the projection, the unit vectors and their
    labels: about 2.7 MB at the default bounds, whatever the size of the corpus. ``labelled_sample``
    says which rows are left out; null and empty texts have no terms; other columns are ignored.
    """
    sample = labelled_sample(docs, labels, label_col, {0: most_labelled // 2, 1: most_labelled // 2}, id_col, text_col)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(t.nonzero()[0].astype(np.uint16), t) for t in term_weights(batch.column(0))]
            columns = [pa.array([at.tobytes() for at, _ in held], pa.binary()), pa.array([t[at].tobytes() for at, t in held], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["at", "terms", "label"])

    rows = sorted((r.label, bytes(r.at), bytes(r.terms)) for r in sample.mapInArrow(weigh, "at binary, terms binary, label int").limit(2 * most_labelled).collect())
    if not rows:
        return {"axes": np.zeros((N_TERMS, 1), np.float32), "known": np.zeros((0, 1), np.float32), "labels": np.zeros(0, np.float32)}
    weighed = np.zeros((len(rows), N_TERMS), np.float32)
    for own, (_, at, terms) in zip(weighed, rows, strict=True):
        own[np.frombuffer(at, np.uint16)] = np.frombuffer(terms, np.float32)
    rarity = np.clip(np.log(len(rows) / (1 + (weighed > 0).sum(axis=0))) + 1, 0.5, 4).astype(np.float32)
    rarity[-2:] = 2
    weighed *= rarity
    near = weighed @ np.random.default_rng(0).normal(size=(weighed.shape[1], dimensions + 32)).astype(np.float32)
    for _ in range(4):
        near, _ = np.linalg.qr(weighed @ (weighed.T @ near))
    axes = np.linalg.svd(near.T @ weighed, full_matrices=False)[2][:dimensions].T
    known = weighed @ axes
    axes = axes * rarity[:, None]
    known /= np.linalg.norm(known, axis=1, keepdims=True) + 1e-9
    return {"axes": axes.astype(np.float32), "known": known.astype(np.float32), "labels": np.array([label for label, _, _ in rows], np.float32)}


def score_quality(docs: DataFrame, model: dict, neighbours: int = 15, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, score): the mean label of the nearest labelled documents, weighed by cosine similarity.

    The model is broadcast; each task computes exact cosines of its documents with all labelled
    vectors, in blocks. Null or empty texts, which have no direction, get the mean label of the
    model (0.5 without labels). Of labelled vectors that are equally near at the last place, any may
    vote. Ids may be null, each row is scored by itself, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, known, labels = (shared.value[k] for k in ("axes", "known", "labels"))
        prior = float(labels.mean()) if len(labels) else 0.5
        k = min(neighbours, len(labels))

        def vote(block: list[np.ndarray]) -> np.ndarray:
            latent = np.stack(block) @ axes
            length = np.linalg.norm(latent, axis=1)
            scores = np.full(len(block), prior)
            if k:
                cosines = (latent / np.maximum(length, 1e-9)[:, None]) @ known.T
                nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                weight = np.clip(np.take_along_axis(cosines, nearest, axis=1), 0, None).astype(np.float64)
                total = weight.sum(axis=1)
                sure = (length > 1e-9) & (total > 1e-9)
                scores[sure] = ((weight * labels[nearest]).sum(axis=1)[sure] / total[sure]).clip(0, 1)
            return scores

        for batch in batches:
            parts, block = [np.zeros(0)], []
            for terms in term_weights(batch.column(batch.num_columns - 1)):
                block.append(terms)
                if len(block) == 512:
                    parts.append(vote(block))
                    block = []
            if block:
                parts.append(vote(block))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(parts), pa.float64())], [*batch.schema.names[:-1], "score"])

    wanted = docs.select(F.col(id_col), *[F.col(c) for c in carry])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return docs.select(F.col(id_col), *[F.col(c) for c in carry], text_or_empty(text_col)).mapInArrow(score, f"{schema}, score double")
