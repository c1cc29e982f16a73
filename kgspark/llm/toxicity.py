"""Toxicity by a support vector machine on a gapped subsequence kernel, with Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import text_or_empty
from kgspark.llm.labelled import labelled_sample

SIZE = 1 << 15
#: Longest string that is compared in one piece; longer ones are cut into overlapping pieces.
LONGEST = 24
_MARKS = re.compile(r"[^\w\s]|[\d_]")
_SPELLED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


def strings_of(text: str) -> set[str]:
    """The strings that the sentences of a text offer to the kernel.

    Lower-cased words, freed of digits and marks, which so can't hide a word; letters spelled out
    one by one, with any white space and marks between, also count as one word. Words over ``LONGEST`` letters are covered by overlapping
    pieces, so nothing of a text is left out.
    """
    plain = _MARKS.sub("", text.lower())
    found = set(plain.split())
    found.update("".join(run.split()) for run in _SPELLED.findall(plain))
    for word in [w for w in found if len(w) > LONGEST]:
        found.remove(word)
        found.update(word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2))
    return found


def subsequences(words: Sequence[str], decay: float = 0.5, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subsequences of three letters and their weights, one row per word.

    Between two letters up to ``gap`` others may be passed over, each for a factor ``decay``; the
    ends of a word count as letters. Weights are scaled to unit length.
    """
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max()) + 2
    letters = np.zeros((len(words), width), np.int64)
    letters[:, 1:-1] = np.array(words, f"U{width - 2}").view(np.uint32).reshape(len(words), width - 2)
    letters[:, 1:-1] += np.where(letters[:, 1:-1] > 0, 2, 0)
    letters[:, 0] = 1
    letters[np.arange(len(words)), lengths + 1] = 2
    where, weight = [], []
    for g in range(gap + 1):
        for h in range(gap + 1):
            span = 2 + g + h
            if width > span:
                a, b, c = letters[:, : width - span], letters[:, 1 + g : width - span + 1 + g], letters[:, span:]
                where.append((((a * 1000003 + b) * 1000003 + c) * 0x9E3779B1 >> 13) & (SIZE - 1))
                weight.append(np.where(c > 0, decay ** (g + h), 0).astype(np.float32))
    weights = np.concatenate(weight, axis=1)
    return np.concatenate(where, axis=1), weights / (np.sqrt((weights**2).sum(axis=1, keepdims=True)) + 1e-9)


def landmark_table(words: Sequence[str]) -> np.ndarray:
    """One unit column per landmark, over the hashed subsequences."""
    table = np.zeros((len(words), SIZE), np.float32)
    for own, where, weight in zip(table, *subsequences(words), strict=True):
        np.add.at(own, where, weight)
    return np.ascontiguousarray((table / np.linalg.norm(table, axis=1, keepdims=True)).T)


def kernel(words: Sequence[str], table: np.ndarray, power: float) -> np.ndarray:
    """Subsequence kernel of each word with each landmark, raised to ``power`` so that only close ones count."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    order = np.argsort([len(w) for w in words], kind="stable")  # words of like length share a block
    for at in range(0, len(words), 256):
        own = order[at : at + 256]
        where, weight = subsequences([words[i] for i in own])
        out[own] = np.clip((weight[:, None, :] @ table[where])[:, 0, :], 0, 1) ** power
    return out


def _svm(features: np.ndarray, sign: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps; the last feature is the constant."""
    weight = weight / weight.sum()
    v = np.zeros(features.shape[1])
    penalty = 2 * ridge * np.eye(len(v))
    penalty[-1, -1] = 1e-12
    for _ in range(40):
        margin = sign * (features @ v)
        on = margin < 1
        active, w = features[on].astype(np.float64), weight[on]
        step = np.linalg.solve(2 * (active.T * w) @ active + penalty, 2 * active.T @ (w * sign[on] * (1 - margin[on])) - penalty @ v)
        v = v + step
        if np.abs(step).max() < 1e-6:
            break
    return v


class _Scorer:
    """Decision values of strings, remembered, and of texts: that of their most toxic string."""

    def __init__(self, model: dict, most: int = 300_000):
        self.table = landmark_table(model["landmarks"])
        self.model, self.most, self.known = model, most, {}

    def strings(self, words: Sequence[str]) -> np.ndarray:
        return kernel(words, self.table, self.model["power"]) @ self.model["alpha"] + self.model["bias"]

    def texts(self, texts: Sequence[str]) -> list[float]:
        if len(self.known) > self.most:
            self.known.clear()
        known, offered = self.known, [strings_of(t) for t in texts]
        new = list({w for own in offered for w in own if w not in known})
        if new:
            known.update(zip(new, self.strings(new).tolist(), strict=True))
        return [max(map(known.__getitem__, own), default=self.model["bias"]) for own in offered]


def _blocks(column: pa.Array, most: int = 1 << 19) -> Iterator[list[str]]:
    block, size = [], 0
    for value in column:
        block.append(value.as_py() or "")
        size += len(block[-1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    most_toxic: int = 1024,
    most_clean: int = 3072,
    landmarks: tuple[int, int] = (128, 96),
    power: float = 3,
    ridge: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> dict:
    """Fit the machine on the strings (words, and letters spelled out) of labelled documents.

    Of documents at most ``most_toxic`` and ``most_clean`` are read; Spark counts in how many documents of each label a string occurs. A string that
    toxic documents hold more often than chance is a positive instance, weighed by the root of
    that excess, and every string is a negative instance by the root of its clean count.
    Landmarks are the strings of the largest excess and, after each of three rounds, clean strings
    that scored highest; those also join the training set. The landmark kernel's inverse root
    gives Nyström features for a linear machine, and a logistic curve fitted on the sample's
    documents turns decisions into probabilities. ``labelled_sample`` says which rows are left out;
    null and empty texts have no strings; without toxic or without clean documents the machine calls
    every text by the label that there is (clean, if there is none).
    """
    sample = labelled_sample(docs, labels, label_col, {1: most_toxic, 0: most_clean}, id_col, text_col)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = list(strings_of(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int64())], ["word", "label"])

    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {"landmarks": ["-"], "alpha": np.zeros(1), "bias": 0.0, "power": power, "slope": 0.0, "shift": 20.0 if toxic else -20.0}
    excess = F.col("p") - 2 * F.col("n") * toxic / clean
    words = (
        sample.mapInArrow(offer, "word string, label long").groupBy("word").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
        .withColumn("excess", F.when(excess >= 3, excess).otherwise(0.0))
        .withColumn("worth", F.col("excess") * F.log((F.col("p") + 0.5) / toxic / ((F.col("n") + 0.5) / clean)))
    )
    words = words.persist()
    chosen: dict[str, tuple[float, float, float]] = {}

    def join(best: DataFrame, boost: float) -> list[str]:
        rows = best.select("word", "excess", "n").collect()
        for r in rows:
            chosen[r.word] = (r.excess, r.n * toxic / clean, max(boost, chosen.get(r.word, (0, 0, 0))[2]))
        return [r.word for r in rows]

    first = join(words.filter("excess > 0").orderBy(F.desc("worth"), "word").limit(1500), 1)[: landmarks[0]]
    common = join(words.orderBy(F.desc("n"), "word").limit(6000), 1)
    join(words.orderBy(F.xxhash64("word")).limit(6000), 1)
    second = [w for w in common if w not in set(first)][: landmarks[1]]
    for last in (False, False, False, True):
        model = {"landmarks": first + second, "power": power}
        table = landmark_table(model["landmarks"])
        gram = kernel(model["landmarks"], table, power).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
        names = sorted(chosen)
        features = np.c_[kernel(names, table, power) @ root, np.ones(len(names))]
        positive, negative, boost = np.array([chosen[w] for w in names]).T
        weight = np.r_[np.sqrt(positive), np.sqrt(negative) * boost]
        sign = np.repeat([1.0, -1.0], len(names))
        used = weight > 0
        v = _svm(np.r_[features, features][used], sign[used], weight[used], ridge)
        model |= {"alpha": root @ v[:-1], "bias": float(v[-1])}
        if not last:
            shared = docs.sparkSession.sparkContext.broadcast(model)

            def decide(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                scorer = _Scorer(shared.value)
                for batch in batches:
                    if batch.num_rows:
                        values = scorer.strings(batch.column(0).to_pylist()).astype(np.float64)
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, "value"])

            scored = words.filter("excess = 0").select("word", "excess", "n").mapInArrow(decide, "word string, excess double, n long, value double")
            second = [w for w in join(scored.orderBy(F.desc("value"), "word").limit(5000), 10) if w not in set(first)][: landmarks[1]]
    words.unpersist()
    model |= {"slope": 1.0, "shift": 0.0}
    found = _scored(sample.select("label", "text"), model, "label int", raw=True).select("label", "score").collect()
    values, truth = np.array([r.score for r in found]), np.array([r.label for r in found])
    target = np.where(truth == 1, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    fit = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(fit[0] * values + fit[1], -30, 30)))
        x = np.c_[values, np.ones(len(values))]
        curve = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        fit += np.clip(np.linalg.solve(curve, x.T @ (target - p) - 1e-3 * fit), -2, 2)
    return model | {"slope": float(fit[0]), "shift": float(fit[1])}


def _scored(rows: DataFrame, model: dict, schema: str, raw: bool = False) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        slope, shift = shared.value["slope"], shared.value["shift"]
        for batch in batches:
            values = np.array([v for block in _blocks(batch.column(batch.num_columns - 1)) for v in scorer.texts(block)], np.float64)
            out = values if raw else 1 / (1 + np.exp(-np.clip(slope * values + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(score, f"{schema}, score double")


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability that a text is toxic, by its most toxic string.

    Each task holds the landmarks and remembers a bounded number of strings. Null or empty texts
    score as a text without any string; ids may be null; repeated rows score alike; an empty table
    gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return _scored(docs.select(F.col(id_col), text_or_empty(text_col)), model, f"`{id_col}` {kind}")
