"""Near-duplicate documents by circulant MinHash, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import discard, mix64, slices_by_bytes, stored, text_or_empty, utf8_of
from kgspark.llm.components import connected_components

BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i below ``n``."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        grown = []
        for step in (BASE, inverse):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            grown.append(np.multiply.accumulate(factors))
        _powers = tuple(grown)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and where each document's words begin."""
    capital = (data >= 65) & (data <= 90)
    low = data + capital.astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a document's end also ends a word
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = (sums[last + 1] - sums[first]) * down[first]
    return mix64(words), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document."""
    words, begins = word_hashes(data, offsets)
    factors = np.array([pow(int(BASE), 2 * j + 3, 1 << 64) for j in range(width)], np.uint64)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        runs += words[j : j + len(runs)] * factors[j]
    runs = mix64(runs)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mix64(np.array([int((words[a:b] * factors[: b - a]).sum()) ^ int(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _fmix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_minhash(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least of perm(first(s) + k) over all shingles s.

    ``first`` scatters the shingles over the 32-bit integers once; ``perm`` is one permutation of
    them, and adding k shifts it circularly. Two permutations so give any number of coordinates.
    """
    spread = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(spread), 512):
        block = _fmix32(shifts[:, None] + spread[None, at : at + 512])
        np.minimum(least, block.min(axis=1), out=least)
    return least


def bands_for(threshold: float, coordinates: int, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold shares no band with chance ``miss`` at most."""
    for rows in range(12, 0, -1):
        if (1 - threshold**rows) ** (coordinates // rows) <= miss:
            return coordinates // rows, rows
    return coordinates, 1


def _sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = utf8_of(column)
    for first, past in slices_by_bytes(offsets, 1 << 20):
        own = offsets[first : past + 1]
        yield from shingle_sets(data[own[0] : own[-1]], own - own[0], width)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on a set alone."""
    parts = (int(mix64(shingles ^ np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
    return tuple(x - (1 << 64) if x >> 63 else x for x in parts)


def _alike(sketches: np.ndarray, side: np.ndarray, both: bool, least_equal: int) -> list[tuple[int, int]]:
    """Pairs of a bucket whose sketches agree in ``least_equal`` places, as a forest that connects what all such pairs connect.

    A member is first held against the first member of each tree, then against those that are not
    yet in its tree, so a bucket of near copies costs little more than one comparison each.
    With ``both``, only pairs from different blocks (``side``) are compared.
    """
    tree, links = np.arange(len(sketches)), []
    for i in range(1, len(sketches)):
        for heads in (True, False):
            others = tree[:i] != tree[i]
            if heads:
                others &= tree[:i] == np.arange(i)
            if both:
                others &= side[:i] != side[i]
            others = np.flatnonzero(others)
            near = others[(sketches[others] == sketches[i]).sum(axis=1) >= least_equal]
            for j in near[np.unique(tree[near], return_index=True)[1]].tolist():
                one, two = sorted((tree[i], tree[j]))
                tree[: i + 1][tree[: i + 1] == two] = one
                links.append((i, j))
    return links


def _common(one: np.ndarray, two: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    return int((two[at] == one).sum())


def _confirm(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, both: bool, percent: int, least_equal: int) -> list[tuple[int, int]]:
    """Links that connect all members which true links connect: most alike first, each pair not yet connected is compared on full sets.

    ``side``: the block of each member; with ``both``, only pairs from different blocks are compared.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    pairs = []
    for k, i in enumerate(order):
        past = int(np.searchsorted(sizes[order], sizes[i] * 100 // percent, side="right"))
        others = order[k + 1 : past]
        if both:
            others = others[side[others] != side[i]]
        if len(others):
            equal = (sketches[others] == sketches[i]).sum(axis=1)
            near = equal >= least_equal
            if near.any():
                pairs.append(np.stack([equal[near], np.full(near.sum(), i), others[near]], axis=1))
    if not pairs:
        return []
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    ranked = np.concatenate(pairs)
    links = []
    for _, i, j in ranked[np.argsort(-ranked[:, 0], kind="stable")].tolist():
        if (a := root(i)) != (b := root(j)):
            common = _common(sets[i], sets[j])
            if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                parent[a] = b
                links.append((i, j))
    return links


def _by_group(batches: Iterator[pa.RecordBatch], n_keys: int, links) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each run of rows that agree in their first ``n_keys`` columns; the rest of a row goes to ``links``."""
    key, held = None, {}
    for batch in batches:
        out: list[tuple[int, int]] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if len(held) > 1:
                    out += links(key, held)
                key, held = row[:n_keys], {}
            held[row[n_keys]] = row[n_keys + 1 :]
        yield _pairs(out)
    if len(held) > 1:
        yield _pairs(links(key, held))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    width: int = 5,
    coordinates: int = 200,
    block: int = 1024,
    block_shingles: int = 1 << 21,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    A document's set holds the distinct runs of ``width`` words (all words, if fewer), A-Z
    lower-cased; without words it is empty and linked with nothing.

    1. One pass takes each document's set to its size, a 128-bit fingerprint, a circulant MinHash
       signature cut into bands and a sketch of one byte for each coordinate. Bands are so chosen
       that a pair at the threshold shares none with a chance below 1e-6.
    2. Documents of one fingerprint are one class; the class is represented by its smallest id.
    3. Representatives that share a band meet in its bucket. Pairs of a bucket whose sketches are
       not more than five standard deviations below the threshold are ties; a task emits a
       spanning forest of them. The components of ties are groups of candidates, so texts that
       share a band by chance, or a template of middling similarity, don't grow into one group.
    4. Each group is compared inside tasks: such pairs, most alike first, are confirmed on full
       sets unless already connected, and again only a spanning forest leaves a task. A bucket of
       over ``block`` members, or a group of over ``block`` members or ``block_shingles``
       shingles, is dealt out as pairs of blocks, so all its pairs are met while no task holds
       more than two blocks.
    5. The components of confirmed links are the result.

    Returns one row per input row: id, n_shingles, component_id (smallest id reachable), kept
    (the id is its component's). Ids are integers. Null text counts as empty; a null id forms no
    links by itself and keeps a null component unless its text is copied by a row with an id;
    repeated rows share a class; an empty table gives an empty result; other columns, whatever
    their names, are ignored. A text is held whole by the task that reads it, with about 40 bytes
    for each of its own.
    """
    threshold = percent / 100
    n_bands, n_rows = bands_for(threshold, coordinates)
    least_equal = int(coordinates * threshold - 5 * (coordinates * threshold * (1 - threshold)) ** 0.5)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.array([pow(int(BASE), 2 * j + 1, 1 << 64) for j in range(n_rows)], np.uint64)
        salts = mix64(np.arange(1, n_bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, prints, bands, sketches, lengths = [], [], [], [], [0]
            for own in _sets_of(batch.column(1), width):
                sizes.append(len(own))
                prints.append(_fingerprint(own))
                if len(own):
                    least = circulant_minhash(own, coordinates)
                    rows = least[: n_bands * n_rows].reshape(n_bands, n_rows).astype(np.uint64)
                    bands.append(mix64((rows * factors).sum(axis=1, dtype=np.uint64) ^ salts).view(np.int64))
                    sketches.append((least & np.uint32(0xFF)).astype(np.uint8).tobytes())
                else:
                    sketches.append(b"")
                lengths.append(lengths[-1] + (n_bands if len(own) else 0))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            one, two = zip(*prints, strict=True) if prints else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), pa.array(sketches, pa.binary())],
                ["id", "n", "d1", "d2", "bands", "sketch"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = stored(texts.mapInArrow(sign, "id long, n long, d1 long, d2 long, bands array<long>, sketch binary"))

    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "n", "bands", "sketch")
    classes = stored(rows.filter("n > 0").groupBy("d1", "d2").agg(F.min(first).alias("m")).select("d1", "d2", F.col("m.id").alias("rep"), "m.n", "m.bands", "m.sketch"))
    reps = classes.filter("rep IS NOT NULL")

    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = stored(banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    buckets = banded.join(shared, "band").select("band", "rep", blocks.alias("blocks")).join(reps.select("rep", "sketch"), "rep")
    buckets = buckets.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = buckets.select("*", others).select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "own", "sketch")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple, held: dict) -> list[tuple[int, int]]:
            ids = sorted(held, key=lambda x: (held[x][0], x))
            sketches = np.frombuffer(b"".join(held[x][1] for x in ids), np.uint8).reshape(len(ids), coordinates)
            return [(ids[i], ids[j]) for i, j in _alike(sketches, np.array([held[x][0] for x in ids]), key[1] != key[2], least_equal)]

        return _by_group(batches, 3, links)

    ties = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(tie, "a long, b long")
    groups = connected_components(ties).withColumnRenamed("component", "grp")

    shape = groups.join(reps.select(F.col("rep").alias("node"), "n"), "node").groupBy("grp").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")
    )
    members = stored(
        groups.join(shape, "grp")
        .join(reps.select(F.col("rep").alias("node"), "d1", "d2", "sketch"), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets = [], []
            for i, (own, one, two) in enumerate(zip(_sets_of(batch.column(0), width), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if _fingerprint(own) == (one, two):  # rows of one id may differ in text
                    keep.append(i)
                    sets.append(own.tobytes())
            kept = batch.select(list(range(3, batch.num_columns))).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], [*kept.schema.names, "shingles"])

    with_text = members.join(texts, F.col("node") == F.col("id")).select("text", "d1", "d2", "node", "grp", "blocks", "own", "sketch")
    sets = with_text.mapInArrow(full_sets, "node long, grp long, blocks int, own int, sketch binary, shingles binary")
    dealt = sets.select("*", others).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "sketch", "shingles")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple, held: dict) -> list[tuple[int, int]]:
            ids = list(held)
            sketches = np.frombuffer(b"".join(held[x][1] for x in ids), np.uint8).reshape(len(ids), coordinates)
            found = _confirm([np.frombuffer(held[x][2], np.uint64) for x in ids], sketches, np.array([held[x][0] for x in ids]), key[1] != key[2], percent, least_equal)
            return [(ids[i], ids[j]) for i, j in found]

        return _by_group(batches, 3, links)

    dealt = dealt.select("grp", "i", "j", "node", "own", "sketch", "shingles").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    links = stored(dealt.mapInArrow(confirm, "a long, b long"))
    found = connected_components(links)
    named = classes.select("d1", "d2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    named = stored(named)
    discard(classes, shared, members, links)
    return (
        rows.select("id", "n", "d1", "d2")
        .join(named, ["d1", "d2"], "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
