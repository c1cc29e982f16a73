"""Hierarchical packing of tokenised documents into windows of several lengths."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import text_or_empty

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies, with possessive repeats.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


#: Fixed value: the characters of ``\s`` above. A long run of them is one match, which nothing may shorten.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}+")


class ByteLevelEncoder:
    """Ids of a byte-level BPE vocabulary file of ``tokenizers``, as that library gives them.

    The vocabulary is run by ``tiktoken``, which gives the same ids several times faster. A text
    is cut at the strings of special tokens, which have ids of their own, and, where other text
    follows a long run of white space, before the last character of the run: there a pre-token
    ends in any case. A run at the end of a text, or before a special token, is one pre-token.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bpe = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cuts = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        ids, at = array("I"), 0
        for special in self.cuts.finditer(text):
            ids += self._plain(text[at : special.start()])
            ids.append(self.special[special.group()])
            at = special.end()
        return (ids + self._plain(text[at:])).tobytes()

    def _plain(self, text: str) -> array:
        ids, at = array("I"), 0
        for space in _LONG_SPACE.finditer(text):
            if space.end() < len(text):
                ids += array("I", self.bpe.encode_ordinary(text[at : space.end() - 1]))
                at = space.end() - 1
        return ids + array("I", self.bpe.encode_ordinary(text[at:]))


class _Packer:
    """Pools of pieces by tier, and the windows made of them; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, tiers: Sequence[int]):
        self.tiers = sorted(tiers)
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.order = self.waiting = self.full = 0
        self.windows: list[tuple[int, list]] = []

    def route(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.order += 1
        self.waiting += length
        insort(self.pools[next(t for t in self.tiers if t >= length)], (length, self.order, piece))

    def add(self, doc, ids: bytes) -> None:
        """Whole windows of the longest tier leave at once; the rest is routed to a tier."""
        total, step = len(ids) // 4, 4 * self.tiers[-1]
        for at in range(0, len(ids) - step + 1, step):
            self.windows.append((self.tiers[-1], [(doc, at // 4, ids[at : at + step], total)]))
            self.full += 1
        if rest := ids[len(ids) - len(ids) % step :]:
            self.route((doc, total - len(rest) // 4, rest, total))

    def take(self, tier: int, at: int) -> tuple:
        length, _, piece = self.pools[tier].pop(at)
        self.waiting -= length
        return piece

    def filler(self, tier: int, gap: int) -> tuple | None:
        """The longest whole piece of a shorter tier that fits, else as much as fits of the longest piece left."""
        shorter = [t for t in reversed(self.tiers) if t < tier]
        for t in shorter:
            if at := bisect_right(self.pools[t], (gap, float("inf"))):
                return self.take(t, at - 1)
        for t in [*shorter, tier]:
            if self.pools[t]:
                doc, start, ids, total = self.take(t, -1)
                if len(ids) > 4 * gap:
                    self.route((doc, start + gap, ids[4 * gap :], total))
                return doc, start, ids[: 4 * gap], total
        return None

    def pack(self, last: bool) -> None:
        """Fill windows from the longest tier down; what can't fill one waits, or at the end is split into powers of two."""
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                window = [self.take(tier, -1)]
                gap = tier - len(window[0][2]) // 4
                while gap and (piece := self.filler(tier, gap)):
                    window.append(piece)
                    gap -= len(piece[2]) // 4
                if not gap:
                    self.windows.append((tier, window))
                elif not last:
                    for piece in window:
                        self.route(piece)
                    break
                else:
                    self.split(window)

    def split(self, pieces: list) -> None:
        left = sum(len(p[2]) for p in pieces) // 4
        pieces = pieces[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            window, gap = [], size
            while gap:
                doc, start, ids, total = pieces.pop()
                if len(ids) > 4 * gap:
                    pieces.append((doc, start + gap, ids[4 * gap :], total))
                window.append((doc, start, ids[: 4 * gap], total))
                gap -= len(window[-1][2]) // 4
            self.windows.append((size, window))


def _steps(windows: list[tuple[int, list]], step_tokens: int, last: bool) -> tuple[list, list]:
    """Deal windows of one length out to step groups of ``step_tokens`` tokens, those of most pieces in turn, back and forth."""
    by_size: dict[int, list] = {}
    for size, window in windows:
        by_size.setdefault(size, []).append((size, window))
    groups, rest = [], []
    for size, own in sorted(by_size.items(), reverse=True):
        each = max(1, step_tokens // size)
        n = len(own) // each
        full = sorted(own[: n * each], key=lambda w: -len(w[1]))
        dealt: list[list] = [[] for _ in range(n)]
        for i, window in enumerate(full):
            turn, at = divmod(i, n)
            dealt[at if turn % 2 == 0 else n - 1 - at].append(window)
        groups += dealt
        rest += own[n * each :]
    return (groups + [[w for w in rest if w[0] == s] for s in sorted({w[0] for w in rest}, reverse=True)], []) if last else (groups, rest)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: Sequence[int] = (256, 512, 1024, 2048),
    end_id: int = 1,
    step_tokens: int = 65_536,
    buffer_tokens: int = 1 << 20,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise documents and pack all their ids into windows of several lengths.

    A document's ids, with ``end_id`` after them, give whole windows of the longest tier first;
    the rest goes to the shortest tier that holds it. From the longest tier down, each window
    starts with the longest piece of its tier, its gap takes the longest pieces of shorter tiers
    that fit, and the last gap takes the front of a longer piece. What is left at the end of a
    partition is split into windows of powers of two. So nothing is padded as long as the tiers
    are powers of two. Windows of one length make up step groups of ``step_tokens`` tokens
    with like numbers of pieces.

    Each task packs its own partition and holds about ``buffer_tokens`` ids: no shuffle at all,
    and a lost task is repeated alone. Returns one row per piece: id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, window, step_group and, if asked for, ids. Null or empty
    text is the end id alone; repeated rows and null ids are packed each; a very long text is
    encoded whole, in the memory of its task, and its windows leave at once; an empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    layout = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window int, step_group bigint"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_id = TaskContext.get().partitionId() << 32
        encoder, packer = ByteLevelEncoder(tokenizer_path), _Packer(tiers)
        sequence = group = first_id
        windows: list = []
        id_kind = None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group, windows
            packer.pack(last)
            groups, windows = _steps(windows + packer.windows, step_tokens, last)
            packer.windows, packer.full = [], 0
            rows: list[tuple] = []
            parts: list[bytes] = []
            for own in groups:
                for size, window in own:
                    offset = 0
                    for doc, start, ids, total in window:
                        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, size, group))
                        offset += len(ids) // 4
                        if with_ids:
                            parts.append(ids)
                    sequence += 1
                group += 1
            if rows:
                kinds = [id_kind, *[pa.int64()] * 6, pa.int32(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
                if with_ids:
                    ends = np.cumsum([0, *[r[2] for r in rows]]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, encoder.encode(text.as_py()) + end)
                if packer.waiting + packer.full * packer.tiers[-1] >= buffer_tokens:
                    yield from flush(False)
        if id_kind is not None:
            yield from flush(True)

    schema = f"`{id_col}` {id_type}, {layout}" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, schema)
