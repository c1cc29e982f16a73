"""Removal of long byte strings that occur more than once, by sorting sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import discard, mix64, slices_by_bytes, stored, text_or_empty, utf8_of

BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i below ``n``."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, made = max(n, 1 << 20), []
        for step in (base, pow(base, -1, 1 << 64)):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _powers[base] = tuple(made)
    up, down = _powers[base]
    return up[:n], down[:n]


class Prefixes:
    """Prefix polynomial hashes of a byte string: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        up, self.down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        own = self.sums[1:]  # one array in all: contexts of a common gram take megabytes
        own[:] = data
        own += np.uint64(1)
        own *= up[: len(data)]
        np.cumsum(own, out=own)

    def of(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        return (self.sums[past] - self.sums[first]) * self.down[first]


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = least(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, place, gram hash, context digest) of each anchor of the documents laid end to end.

    Every string of ``length`` bytes within a document has its grams of ``gram`` bytes of least
    hash as anchors, so equal strings have equal anchors at equal places. The context of an
    anchor is all that any such string around it can reach, cut at the document's ends; its
    digest has 128 cryptographic bits, so equal digests stand for equal bytes around the anchor.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [])
    if len(data) < length:
        return none
    reach = length - gram
    hashes = Prefixes(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix64(hashes.of(at, at + gram)) | np.uint64(1)
    least = _sliding(grams, reach + 1, np.minimum)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.arange(len(least)) + length <= offsets[doc[: len(least)] + 1]
    least[~inside] = 0
    padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(len(grams) - len(least), np.uint64)])
    place = np.flatnonzero(_sliding(padded, reach + 1, np.maximum) == grams)
    if not len(place):
        return none
    own = doc[place]
    first, past = np.maximum(offsets[own], place - reach), np.minimum(offsets[own + 1], place + gram + reach)
    raw = memoryview(np.ascontiguousarray(data))
    around = [hashlib.blake2b(raw[a:b], digest_size=16, salt=n.to_bytes(4, "little")).digest() for a, b, n in zip(first.tolist(), past.tolist(), (place - first).tolist(), strict=True)]
    return own, place - offsets[own], grams[place], around


class Suffixes:
    """Suffixes of strings laid end to end, each cut at its own string's end, sorted by mergesort.

    Two suffixes are compared in logarithmic time: a binary search on prefix hashes finds their
    common extension, and the byte after it decides. All merges of a level run at once.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, past: np.ndarray):
        self.data, self.first, self.size = data, first, past - first
        self.prefixes = Prefixes(data)
        self.order = self._sorted()
        self.common = np.concatenate([[0], self.extension(self.order[:-1], self.order[1:])]) if len(first) else np.zeros(0, np.int64)
        if not self._verified():
            self._plainly()
        del self.prefixes

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j."""
        a, b = self.first[i], self.first[j]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[i], self.size[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.prefixes.of(a, a + middle) == self.prefixes.of(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.extension(i, j)
        ended_i, ended_j = n >= self.size[i], n >= self.size[j]
        last = len(self.data) - 1
        by_byte = self.data[np.minimum(self.first[i] + n, last)] < self.data[np.minimum(self.first[j] + n, last)]
        return np.where(ended_j, False, np.where(ended_i, True, by_byte))

    def _sorted(self) -> np.ndarray:
        n, order, width = len(self.first), np.arange(len(self.first)), 1
        at = np.arange(n)
        while width < n:
            run = at // width
            left = run % 2 == 0
            other = np.minimum(np.where(left, run + 1, run - 1) * width, n)  # where the partner run begins
            low, high = other.copy(), np.minimum(other + width, n)
            for _ in range(width.bit_length()):
                open_ = low < high
                if not open_.any():
                    break
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) >> 1
                mine, theirs = order[k], order[middle]
                # Partners that go before: lesser ones, and for the right run also equal ones.
                is_left = left[k]
                one, two = np.where(is_left, theirs, mine), np.where(is_left, mine, theirs)
                before = np.where(is_left, self.less(one, two), ~self.less(one, two))
                low[k[before]] = middle[before] + 1
                high[k[~before]] = middle[~before]
            start = np.where(left, run, run - 1) * width
            place = start + (at - run * width) + (low - other)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, width * 2
        return order

    def _verified(self) -> bool:
        """No hash collision: the common bytes of neighbours are equal, and the next decides."""
        for at in range(1, len(self.order), 4096):
            i, j, n = self.order[at - 1 : at + 4095], self.order[at : at + 4096], self.common[at : at + 4096]
            i = i[: len(j)]
            step = np.arange(int(n.max(initial=0)))
            used = step[None, :] < n[:, None]
            last = len(self.data) - 1
            if (used & (self.data[np.minimum(self.first[i][:, None] + step, last)] != self.data[np.minimum(self.first[j][:, None] + step, last)])).any():
                return False
            ends = (n >= self.size[i]) | (n >= self.size[j])
            if (~ends & (self.data[np.minimum(self.first[i] + n, last)] >= self.data[np.minimum(self.first[j] + n, last)])).any():
                return False
        return True

    def _plainly(self) -> None:
        """After a collision: sort by the bytes themselves."""
        strings = [self.data[a : a + n].tobytes() for a, n in zip(self.first, self.size, strict=True)]
        self.order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
        common = [0]
        for i, j in zip(self.order[:-1], self.order[1:], strict=True):
            a, b = (np.frombuffer(strings[x], np.uint8) for x in (i, j))
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common.append(int(differ[0]) if len(differ) else n)
        self.common = np.array(common, np.int64)

    def classes(self, depth: int) -> np.ndarray:
        """For each suffix the number of its class of suffixes that agree in ``depth`` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def repeated_reach(contexts: list[bytes], before: list[int], low: list[int], high: list[int], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context, how far the strings that another context repeats reach before its anchor, most and least (-1: none).

    ``before``: the place of the anchor in each context; only reaches from ``low`` to ``high`` count. A string of ``length`` bytes that begins
    s bytes before the anchor is repeated if another context agrees in s bytes before the anchor
    and in the rest after it; both come from the order of suffixes, one of the contexts and one
    of their mirror images.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    at = ends - sizes + np.array(before, np.int64)
    after = Suffixes(data, at, ends)
    mirror = data[::-1]
    ahead = Suffixes(mirror, len(data) - at, len(data) - (ends - sizes))
    most, least = np.full(len(contexts), -1), np.full(len(contexts), -1)
    low, high = np.array(low), np.array(high)
    for s in range(int(low.min()), int(high.max()) + 1):
        keys = after.classes(length - s) * len(contexts) + (ahead.classes(s) if s else 0)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        again &= (low <= s) & (s <= high)
        most[again] = s
        least[again & (least < 0)] = s
    return most, least


def _halved(hot: DataFrame, reach: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Groups of contexts split by halves of their range, and the spans that equal contexts settle.

    Of a group's strings those that begin ``low`` to ``high`` bytes before the anchor are in
    question. All strings of a half share the bytes from its ``low`` before the anchor on, so
    contexts that differ there share none of them and part. A half looks at no more than its own
    reach; contexts that are equal so far are one context from then on, and no longer open.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    half = F.explode(F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high")))
    after = F.length("context") - F.col("ahead") - gram
    rows = hot.filter("low < high").withColumn("half", half).select("key", "p1", "p2", "at", "ahead", "open", "context", "half.low", "half.high")
    rows = rows.filter((F.col("ahead") >= F.col("low")) & (after >= reach - F.col("high")))
    common = F.substring(F.col("context"), F.col("ahead") - F.col("low") + 1, F.col("low") + gram + reach - F.col("high"))
    ahead = F.least("ahead", "high")
    own = F.substring(F.col("context"), F.col("ahead") - ahead + 1, ahead + gram + F.least(after, reach - F.col("low")))
    rows = rows.select(
        F.md5(F.concat(F.col("key").cast("binary"), F.concat_ws(":", F.lit(""), "low", "high", F.lit("")).cast("binary"), common)).alias("key"),
        F.unhex(F.md5(F.concat(ahead.cast("string").cast("binary"), F.lit(":").cast("binary"), own))).alias("c"),
        "p1", "p2", "low", "high", "at", ahead.alias("ahead"), "open", own.alias("context"),
    )
    rows = stored(rows)
    classes = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.first(F.struct(*[x for x in rows.columns if x not in ("key", "c")])).alias("m"))
    classes = stored(classes.select("key", "c", "n", "m.p1", "m.p2", "m.low", "m.high", "m.at", "m.ahead", (F.col("m.open") & (F.col("n") == 1)).alias("open"), "m.context"))
    sizes = stored(classes.groupBy("key").agg(F.count("*").alias("members"), F.bool_or("open").alias("any_open")).filter("members > 1 AND any_open").select("key", "members"))
    equal = rows.filter("open").join(classes.filter("n > 1").select("key", "c"), ["key", "c"], "left_semi")
    return classes.drop("n").join(sizes, "key"), equal.select("p1", "p2", (F.col("at") - F.col("ahead")).alias("first"), (F.col("at") - F.col("ahead") + F.length("context")).alias("past"))


def remove_repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 160, most_members: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the bytes that strings of ``length`` bytes which start more than once cover.

    1. A scan samples anchors (see ``anchors``): about one in 120 bytes at the defaults. A gram
       that is an anchor once proves that no string around it is repeated, and is dropped.
    2. Of the others, anchors whose whole context is repeated, by a cryptographic digest of its
       bytes, are settled by that.
    3. The rest, at the edges of repeated passages, fetch their contexts. Those of one gram meet
       in a task, where sorted suffixes on both sides of the anchors tell which strings are
       repeated, with hashes checked against bytes. A group of over ``most_members`` contexts is
       split first, as often as needed: by halves of the range of places where a string may
       begin, and by the bytes that all strings of a half have in common. Contexts that are equal
       as far as a half reaches are settled by that; strings of one place are equal or apart.
    4. What anchors cover makes up the removed runs of each text.

    Texts of one fingerprint (128 bits) are looked at once and their rows counted, so copies cost
    little. Returns one row per input row: id, n_bytes, n_removed, n_spans, kept (binary). Null
    text counts as empty; overlapping occurrences and those within one document count; repeated
    rows and null ids are documents each; an empty table gives no rows; other columns, whatever
    their names, are ignored. A very long text is scanned whole, in about 60 bytes of memory for
    each of its own.
    """
    reach = length - gram
    text = text_or_empty(text_col)
    keyed = docs.select(F.xxhash64(text).alias("p1"), F.xxhash64(F.lit(1), text).alias("p2"), text.alias("text"), F.col(id_col).alias("id"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(2))
            for first, past in slices_by_bytes(offsets, 1 << 20):
                at = offsets[first : past + 1] - offsets[first]
                own, place, grams, around = anchors(data[offsets[first] : offsets[past]], at, length, gram)
                rows, size = pa.array(own + first), np.diff(at)[own]
                cut = [pa.array(x.astype(np.int32)) for x in (place, np.minimum(place, reach), np.minimum(size - place - gram, reach))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *cut, pa.array(grams.view(np.int64)), pa.array(around, pa.binary())], ["p1", "p2", "at", "ahead", "after", "g", "c"]
                )

    sampled = stored(keyed.select("p1", "p2", "text").mapInArrow(sample, "p1 long, p2 long, at int, ahead int, after int, g long, c binary"))
    often = stored(sampled.groupBy("g").count().filter("count > 1").select("g"))  # stored: Spark may split a hot gram in the join
    again = stored(sampled.join(often, "g", "left_semi"))
    contexts = again.groupBy("g", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("p1", "p2", "at", "ahead", "after")])
    contexts = stored(contexts)
    discard(sampled, often)
    edges = contexts.groupBy("g").agg(F.count("*").alias("members"), F.count(F.when(F.col("n") == 1, 1)).alias("single")).filter("members > 1 AND single > 0").select("g", "members")
    settled = again.join(contexts.filter("n > 1").select("g", "c"), ["g", "c"], "left_semi").select(
        "p1", "p2", (F.col("at") - F.col("ahead")).alias("first"), (F.col("at") + gram + F.col("after")).alias("past")
    )
    edges = stored(edges)
    wanted = contexts.join(edges, "g").groupBy("p1", "p2").agg(F.collect_list(F.struct("g", "c", "at", "ahead", "after", "members", (F.col("n") == 1).alias("open"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], [], [], []]
            for p1, p2, text, some in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py().encode()
                for x in some.as_py():
                    row = (p1.as_py(), p2.as_py(), x["g"], x["c"], x["at"], x["ahead"], x["members"], x["open"], data[x["at"] - x["ahead"] : x["at"] + gram + x["after"]])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int32()] * 2 + [pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["p1", "p2", "g", "c", "at", "ahead", "members", "open", "context"])

    fetched = stored(keyed.select("p1", "p2", "text").join(wanted, ["p1", "p2"]).select("p1", "p2", "text", "wanted").mapInArrow(cut, "p1 long, p2 long, g long, c binary, at int, ahead int, members long, open boolean, context binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], tuple] = {}

        def found() -> pa.RecordBatch:
            rows = list(held.values())
            columns = list(zip(*rows, strict=True))
            most, least = repeated_reach(columns[6], columns[4], columns[2], columns[3], length, gram) if len(rows) > 1 else (np.full(len(rows), -1),) * 2
            hits = [(r[0], r[1], r[7] - m, r[7] - n + length) for r, m, n in zip(rows, most.tolist(), least.tolist(), strict=True) if r[5] and m >= 0]
            columns = list(zip(*hits, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["p1", "p2", "first", "past"])

        key = None
        for batch in batches:
            for new, c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if new != key and len(held) >= 4096:
                    yield found()
                    held.clear()
                key = new
                held[new, c] = tuple(row)
        yield found()

    parts = ["p1", "p2", "low", "high", "ahead", "open", "context", "at"]
    groups = fetched.select(F.col("g").cast("string").alias("key"), "c", "p1", "p2", F.lit(0).alias("low"), F.lit(reach).alias("high"), "ahead", "open", "context", "at", "members")
    kept, whole = groups.filter(F.col("members") <= most_members).drop("members"), []
    hot = groups.filter(F.col("members") > most_members).dropDuplicates(["key", "c"])
    while not hot.isEmpty():
        groups, equal = _halved(hot, reach, gram)
        whole.append(equal)
        kept = kept.unionByName(groups.filter(F.col("members") <= most_members).drop("members"))
        hot = groups.filter(F.col("members") > most_members)
    compared = kept.select("key", "c", *parts).repartition("key").sortWithinPartitions("key").mapInArrow(compare, "p1 long, p2 long, first int, past int")
    for equal in whole:
        compared = compared.unionByName(equal)

    spans = stored(settled.unionByName(compared).groupBy("p1", "p2").agg(F.collect_set(F.struct("first", "past")).alias("spans")))
    discard(again, contexts, edges, fetched)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, some in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                runs: list[list[int]] = []
                for first, past in sorted((x["first"], x["past"]) for x in some.as_py() or ()):
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], past)
                    else:
                        runs.append([first, past])
                edges_ = [0, *[x for r in runs for x in r], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges_[::2], edges_[1::2], strict=True)) if runs else data
                for column, value in zip(out, (len(data), len(data) - len(kept), len(runs), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = keyed.join(spans, ["p1", "p2"], "left").select("id", "text", "spans")
    return joined.mapInArrow(remove, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
