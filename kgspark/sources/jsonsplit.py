"""Card files of any size: one row per card, read in splits and in bounded memory.

A file is read as the fragments between its closing braces, so Spark splits it wherever one
stands. What a fragment means depends on what came before: whether it begins within a string, and
in which objects. A first pass sums up each split for both beginnings, a fold over the summaries of
a file gives each split its true one, and a second pass cuts the cards out. Cards that a split's
edge breaks are put together again from their pieces. The fragments are shuffled once, by split; whole cards are not
shuffled again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A string, closed or not, or a bracket. Possessive runs, so a long string takes no stack.
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("?)|[{}\[\]]', re.S)
#: Identities: the number of the split times this, and the number of the bracket within it.
_SPLIT = 1 << 33
_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("begun", pa.bool_()), ("inside", pa.bool_()), ("closed", pa.int64()), ("opened", pa.string())])
_PIECE = pa.schema([("entry", pa.int64()), ("own", pa.int64()), ("carded", pa.bool_()), ("whole", pa.bool_()), ("place", pa.int64()), ("text", pa.string())])


class Splitter:
    """Follows the objects of one split; ``stack`` holds (bracket, whether its key is "cards", identity) of what is open."""

    def __init__(self, number: int, inside: bool = False, stack: list[tuple] | None = None):
        self.opened = self.placed = self.first = number * _SPLIT
        self.stack, self.closed = list(stack or []), 0
        # A split that begins within a string gets a quote before it, which belongs to no piece.
        self.text, self.mark, self.inside, self.broken = '"' if inside else "", int(inside), inside, inside
        self.kept: list[str] = []
        self.pieces: list[tuple[int, int, bool, bool, int, str | None]] = []

    def role(self) -> str:
        """What the innermost open object is: an entry of the file, the cards of one, or a card among these."""
        s, n = self.stack, len(self.stack)
        if n < 2 or n > 4 or s[-1][0] != "{" or s[0][0] != "{" or s[1][0] != "{":
            return ""
        return "entry" if n == 2 else ("cards" if n == 3 else "card") if s[2][0] == "{" and s[2][1] else ""

    def within(self) -> tuple[int, int, bool] | None:
        """(entry, identity, whether a card of a set) of what text now belongs to: a card, or else an entry outside of its cards."""
        s, n = self.stack, len(self.stack)
        if n < 2 or s[0][0] != "{" or s[1][0] != "{":
            return None
        if n > 2 and s[2][0] == "{" and s[2][1]:
            return (s[1][2], s[3][2], True) if n > 3 and s[3][0] == "{" else None
        return s[1][2], s[1][2], False

    def flush(self, end: int, closing: bool) -> None:
        """What was read of the card or entry becomes a piece; one that also began here is whole."""
        owner = self.within()
        if owner:
            entry, own, carded = owner
            self.placed += 1
            self.pieces.append((entry, own, carded, closing and own >= self.first, self.placed, "".join([*self.kept, self.text[self.mark : end]])))
        self.kept = []

    def feed(self, text: str) -> None:
        self.text += text
        end, key, past = len(self.text), None, 0
        for m in _TOKEN.finditer(self.text):
            sign = m.group()
            if sign[0] == '"':
                if not m.group(1):
                    end = m.start()
                    break
                key, past, self.broken = None if self.broken else sign, m.end(), False
            elif sign in "{[":
                # A key and its bracket share a fragment, since no brace closes between them.
                named = key is not None and self.text[past : m.start()].strip() == ":" and (json.loads(key, strict=False) if "\\" in key else key[1:-1]) == "cards"
                if named and sign == "{" and self.role() == "entry":  # a mark says that the entry is a set, not a card
                    self.kept = []
                    self.pieces.append((self.stack[1][2], self.stack[1][2], False, False, 0, None))
                self.opened += 1
                self.stack.append((sign, named, self.opened))
                if self.role() in ("entry", "card"):
                    self.kept, self.mark = [], m.start()
            elif self.stack:
                if self.role() in ("entry", "card"):
                    self.flush(m.end(), True)
                elif self.role() == "cards":
                    self.kept, self.mark = [], m.end()
                self.stack.pop()
            else:
                self.closed += 1
        if self.mark < end:
            if self.within():
                self.kept.append(self.text[self.mark : end])
            self.mark = 0
        else:
            self.mark -= end
        self.text = self.text[end:]
        self.inside = bool(self.text)

    def finish(self) -> None:
        """The end of the split: what is open goes on in the next one."""
        self.flush(len(self.text), False)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, str]]:
    """(key, text) of neighbouring rows with one key; the brace that ended a fragment is put back."""
    for batch in batches:
        columns, value = [batch.column(k) for k in keys], batch.column("value")
        at = lambda i: tuple(c[i].as_py() for c in columns)
        first = 0
        while first < len(value):
            key, past = at(first), len(value)
            if at(past - 1) != key:  # rows of one key stand together, so the last of them can be halved for
                low = first
                while past - low > 1:
                    middle = (low + past) // 2
                    low, past = (middle, past) if at(middle) == key else (low, middle)
            yield key, "}".join(value.slice(first, past - first).to_pylist()) + "}"
            first = past


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and both ways to begin: what it closes of what was open, what it leaves open, and whether a string is."""
    now: tuple | None = None
    both: list[Splitter] = []

    def summed() -> pa.RecordBatch:
        return _batch([(*now, begun, x.inside, x.closed, json.dumps(x.stack)) for begun, x in zip((False, True), both, strict=True)], _SUMMARY)

    for key, text in _runs(batches, "file", "block"):
        if key != now:
            if now is not None:
                yield summed()
            now, both = key, [Splitter(0, False), Splitter(0, True)]
        for x in both:
            x.feed(text)
            x.kept, x.pieces = [], []
    if now is not None:
        yield summed()


def _beginnings(splits: pd.DataFrame) -> pd.DataFrame:
    """Each split's true beginning, folded over the splits of one file; identities get the split's number."""
    inside, stack, rows = False, [], []
    for (file, block, number), ways in splits.sort_values("block").groupby(["file", "block", "number"], sort=False):
        rows.append((number, file, block, inside, json.dumps(stack)))
        way = ways[ways["begun"] == inside].iloc[0]
        stack = stack[: max(0, len(stack) - way["closed"])] + [(kind, named, int(number) * _SPLIT + own) for kind, named, own in json.loads(way["opened"])]
        inside = bool(way["inside"])
    return pd.DataFrame(rows, columns=["number", "file", "block", "inside", "stack"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of cards of each split, as they close."""
    now, at = None, None
    for key, text in _runs(batches, "number", "inside", "stack"):
        if key != now:
            if at is not None:
                at.finish()
                yield _batch(at.pieces, _PIECE)
            now, at = key, Splitter(int(key[0]), bool(key[1]), [tuple(x) for x in json.loads(key[2])])
        at.feed(text)
        yield _batch(at.pieces, _PIECE)
        at.pieces = []
    if at is not None:
        at.finish()
        yield _batch(at.pieces, _PIECE)


def split_cards(spark: SparkSession, path: str) -> DataFrame:
    """(pos, card): the JSON text of each card of files that hold {set: {cards: {id: card}}} or cards by themselves.

    ``pos`` follows the files' order and, within one, that of the text. An entry of the file without
    an object ``cards`` is a card itself; entries and cards that are no objects are left out.
    Files must be valid JSON; in one that breaks off, the object at the break may count as closed there. Empty files have no cards. A task holds a batch of
    fragments and the card that it reads, whatever the size of the file or of a set; splits are as
    long as ``spark.sql.files.maxPartitionBytes`` says. A compressed file is one split.
    """
    read = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    fragments = read.withColumn("n", F.monotonically_increasing_id())
    summed = fragments.select("file", "block", "value").mapInArrow(_summaries, "file string, block long, begun boolean, inside boolean, closed long, opened string")
    # One pair of rows for each split of all files, which one task can number.
    numbered = summed.withColumn("number", F.dense_rank().over(W.orderBy("file", "block")).cast("long"))
    begun = numbered.groupBy("file").applyInPandas(_beginnings, "number long, file string, block long, inside boolean, stack string")
    # Each split is a key of its own, no longer than a split, and streams through its task in order.
    dealt = fragments.join(begun, ["file", "block"]).select("number", "inside", "stack", "n", "value").repartition("number").sortWithinPartitions("number", "n")
    pieces = dealt.select("number", "inside", "stack", "value").mapInArrow(_cut, "entry long, own long, carded boolean, whole boolean, place long, text string")
    return _assembled(pieces)


def _assembled(pieces: DataFrame) -> DataFrame:
    """Cards of sets that are whole as they are; broken ones and cards by themselves once their pieces met."""
    whole = F.col("carded") & F.col("whole")
    # Closed pieces end with a brace whose place is the greatest; what never closes has no such piece.
    met = pieces.filter(~whole).groupBy("own").agg(
        F.bool_or(F.col("text").isNull()).alias("is_set"), F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text")))).alias("parts")
    )
    joined = met.filter("NOT is_set").select(F.col("own").alias("pos"), F.array_join("parts.text", "").alias("card"))
    return pieces.filter(whole).select(F.col("own").alias("pos"), F.col("text").alias("card")).unionByName(joined)
