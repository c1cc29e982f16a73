"""The prefix trie of conversations, from partial tries that partitions emit and a hash-keyed tree of merges."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import checkpointed, discard, stored

#: Node keys are polynomials of turn digests modulo this prime; the base is an arbitrary number below it.
PRIME, _BASE = (1 << 127) - 1, int.from_bytes(hashlib.sha256(b"conversation prefixes").digest()[:15], "big")

#: Hosts lend at most so many turns: crc32 of the id, modulo this number plus one, says how many.
MOST_LENT = 5

_PARTIAL = "key binary, parent binary, depth bigint, conv_id bigint, n bigint, code_points bigint, part bigint"
_ENDS = "key binary, first_id bigint, ids array<bigint>"


def host_of(conv: int) -> int:
    """c - c % 100 with the remainder's sign that of c, as in SQL."""
    return conv - (abs(conv) % 100 if conv >= 0 else -(abs(conv) % 100))


def lent_turns(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % (MOST_LENT + 1)


class _State:
    """How far one conversation has been rebuilt: own turns seen, turns in the rebuilt sequence, its key."""

    def __init__(self, conv: int, host: list[tuple[bytes, int]]):
        self.conv, self.lent, self.seen, self.depth, self.key = conv, lent_turns(conv), 0, 0, 0
        self.host = host
        self.begun = False

    def step(self, digest: bytes) -> None:
        self.depth += 1
        self.key = (self.key * _BASE + int.from_bytes(digest, "big") + 1) % PRIME


def _key(state: _State) -> bytes:
    return state.depth.to_bytes(8, "big") + state.key.to_bytes(16, "big")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """One narrow row per turn, in order of (host, host first, conversation, turn, digest), as a checkpoint.

    A turn is a 128-bit digest of role and text and the text's number of code points, so texts are
    never shuffled. The order puts a host's turns right before the conversations that begin with
    them, wherever partitions are cut, so no join is needed.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16).alias("digest"),
        F.char_length(text).cast("long").alias("code_points"),
    )
    host = F.col("conv_id") - F.col("conv_id") % 100
    order = [host, host != F.col("conv_id"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    return checkpointed(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "code_points"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, int]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)


def _seams(turns: DataFrame) -> tuple[dict[int, dict], set[int]]:
    """What each partition takes over from those before it, and the partitions whose last conversation goes on.

    Gathers a few numbers of each partition: its first and last conversation, the last one's
    number of turns, its first turns and the polynomial of the rest, and the first turns of the
    last host. So a conversation may span any number of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = host = None
        n, head, rest, n_rest, lent = 0, [], 0, 0, []
        for conv, digest, points in _segments(batches):
            if conv != last:
                first = conv if first is None else first
                last, n, head, rest, n_rest = conv, 0, [], 0, 0
                if host_of(conv) != host:
                    host, lent = host_of(conv), []
            if conv == host and n < MOST_LENT:
                lent.append((digest, points))
            if n < MOST_LENT:
                head.append(digest)
            else:
                rest, n_rest = (rest * _BASE + int.from_bytes(digest, "big") + 1) % PRIME, n_rest + 1
            n += 1
        if last is not None:
            row = {"part": TaskContext.get().partitionId(), "first": first, "last": last, "n": n, "head": head, "rest": rest.to_bytes(16, "big"), "n_rest": n_rest, "lent": [{"d": d, "p": p} for d, p in lent]}
            yield pa.RecordBatch.from_pylist([row], schema=layout)

    layout = pa.schema(
        [("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.binary())), ("rest", pa.binary()), ("n_rest", pa.int64()), ("lent", pa.list_(pa.struct([("d", pa.binary()), ("p", pa.int64())])))]
    )
    schema = "part bigint, first bigint, last bigint, n bigint, head array<binary>, rest binary, n_rest bigint, lent array<struct<d:binary,p:bigint>>"
    rows = sorted(turns.mapInArrow(run, schema).collect(), key=lambda r: r.part)  # one for each partition
    taken: dict[int, dict] = {}
    goes_on: set[int] = set()
    state: _State | None = None
    host, lent = None, []
    for i, r in enumerate(rows):
        taken[r.part] = {"host": host, "lent": list(lent), "conv": None if state is None else state.conv, "seen": state.seen if state else 0, "depth": state.depth if state else 0, "key": state.key if state else 0}
        if host_of(r.last) != host:
            host, lent = host_of(r.last), []
        lent = [*lent, *((bytes(x.d), x.p) for x in r.lent)][:MOST_LENT]
        if state is None or state.conv != r.last:
            state = _State(r.last, [])
            if r.last != host:
                for digest, _ in lent[: state.lent]:
                    state.step(digest)
        own = [bytes(d) for d in r.head]
        # The first turns of this stretch one by one, since the conversation's own first may be left out; the rest at once.
        for digest in own:
            state.seen += 1
            if state.conv == host or state.seen > state.lent:
                state.step(digest)
        state.seen += r.n_rest
        state.key = (state.key * pow(_BASE, r.n_rest, PRIME) + int.from_bytes(r.rest, "big")) % PRIME
        state.depth += r.n_rest
        if i + 1 < len(rows) and rows[i + 1].first == r.last:
            goes_on.add(r.part)
    return taken, goes_on


def partial_tries(turns: DataFrame, flush_nodes: int = 200_000) -> DataFrame:
    """Each partition's own trie: its nodes with counts, and runs of the conversations that end at them.

    Rows of nodes have null ``ids``; rows of ends have key, the run's smallest id and its ids in
    ascending order. A partition holds ``flush_nodes`` nodes at most before it emits them.
    """
    taken, goes_on = _seams(turns)
    seams = turns.sparkSession.sparkContext.broadcast((taken, goes_on))  # a few numbers for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, last_goes_on = seams.value[0].get(part), part in seams.value[1]
        nodes: dict[bytes, list] = {}
        ends: dict[bytes, list[int]] = {}
        n_ends = 0

        def visit(state: _State, parent: bytes | None, points: int) -> bytes:
            key = _key(state)
            node = nodes.get(key)
            if node is None:
                nodes[key] = [parent, state.depth, state.conv, 1, points]
            else:
                node[2], node[3] = min(node[2], state.conv), node[3] + 1
            return key

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal nodes, ends, n_ends
            if nodes:
                parent, depth, conv, n, points = zip(*nodes.values(), strict=True)
                columns = [pa.array(list(nodes), pa.binary()), pa.array(parent, pa.binary()), *(pa.array(c, pa.int64()) for c in (depth, conv, n, points)), pa.array([part] * len(nodes), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.list_(pa.int64()))], names)
            runs = [(key, sorted(ids)) for key, ids in ends.items()]
            if runs:
                none = pa.nulls(len(runs), pa.int64())
                columns = [pa.array([k for k, _ in runs], pa.binary()), pa.nulls(len(runs), pa.binary()), none, none, none, none, none]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for _, r in runs], pa.int64()), pa.array([r for _, r in runs], pa.list_(pa.int64()))], names)
            nodes, ends, n_ends = {}, {}, 0

        state: _State | None = None
        at = b""
        host, lent = (before["host"], list(before["lent"])) if before else (None, [])
        if before and before["conv"] is not None:
            state = _State(before["conv"], [])
            state.seen, state.depth, state.key, state.begun = before["seen"], before["depth"], before["key"], True
            at = _key(state)
        ours = False  # whether the open conversation has a row in this partition
        for conv, digest, points in _segments(batches):
            if state is None or conv != state.conv:
                if ours:
                    ends.setdefault(at, []).append(state.conv)
                    n_ends += 1
                if len(nodes) + n_ends >= flush_nodes:
                    yield from flush()
                if host_of(conv) != host:
                    host, lent = host_of(conv), []
                state = _State(conv, [])
                at = visit(state, None, 0)
                if conv != host:
                    for d, p in lent[: state.lent]:
                        state.step(d)
                        at = visit(state, at, p)
            ours = True
            state.seen += 1
            if conv == host and state.seen <= MOST_LENT:
                lent.append((digest, points))
            if conv == host or state.seen > state.lent:
                state.step(digest)
                at = visit(state, at, points)
                if len(nodes) >= flush_nodes:
                    yield from flush()
        if ours and not last_goes_on:
            ends.setdefault(at, []).append(state.conv)
        yield from flush()

    names = [f.split(" ")[0] for f in f"{_PARTIAL}, first_id bigint, ids array<bigint>".split(", ")]
    return turns.mapInArrow(run, f"{_PARTIAL}, first_id bigint, ids array<bigint>")


def merged_nodes(partial: DataFrame, fan_in: int = 64) -> DataFrame:
    """One row per node: partial nodes of equal key are merged in rounds, ``fan_in`` partitions at a time."""
    nodes = partial
    widest = partial.agg(F.max("part")).first()[0] or 0
    sums = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.first("code_points").alias("code_points")]
    while widest >= fan_in:
        nodes = nodes.groupBy("key", F.floor(F.col("part") / fan_in).alias("part")).agg(*sums)
        widest //= fan_in
    return nodes.groupBy("key").agg(*sums)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending comma-joined ids of all runs of a key.

    Runs meet sorted by key and smallest id, and are hashed as they come: a task holds the ids of
    one run and of those that overlap it, however many conversations end at a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, waiting, done = None, None, np.zeros(0, np.int64), []

        def take(ids: np.ndarray) -> None:
            if len(ids):
                digest.update(",".join(map(str, ids.tolist())).encode() if not digest.any else ("," + ",".join(map(str, ids.tolist()))).encode())

        def emit() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done])], ["key", "ends_sha256"])
                done.clear()

        for batch in batches:
            for k, first_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != key:
                    if key is not None:
                        take(waiting)
                        done.append((key, digest.hexdigest()))
                    key, digest, waiting = k, _Digest(), np.zeros(0, np.int64)
                sure = int(np.searchsorted(waiting, first_id))
                take(waiting[:sure])
                waiting = np.sort(np.concatenate([waiting[sure:], np.asarray(ids.values)])) if sure < len(waiting) else np.asarray(ids.values)
            if len(done) >= 10_000:
                yield from emit()
        if key is not None:
            take(waiting)
            done.append((key, digest.hexdigest()))
        yield from emit()

    runs = ends.select("key", "first_id", "ids").repartition("key").sortWithinPartitions("key", "first_id")
    return runs.mapInArrow(run, "key binary, ends_sha256 string")


class _Digest:
    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def update(self, data: bytes) -> None:
        self.sha.update(data)
        self.any = True

    def hexdigest(self) -> str:
        return self.sha.hexdigest()


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (key, parent, depth and values) with each value summed over the node's subtree, its top included.

    Bottom-up by doubling: after round i a node holds the sums over its descendants less than 2^i
    steps below, and points to its ancestor 2^i steps above; the next round adds the sums of all
    nodes that point to it. A trie of depth d takes log2(d) rounds, each stored before the next.
    """
    current = nodes.select("key", F.col("parent").alias("above"), *values)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    held, step = None, 1
    while step <= deepest:
        below = current.filter(F.col("above").isNotNull()).groupBy(F.col("above").alias("key")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        jump = current.select(F.col("key").alias("above"), F.col("above").alias("next"))
        added = current.join(below, "key", "left").select("key", "above", *((F.col(v) + F.coalesce(F.col(f"{v}_below"), F.lit(0))).alias(v) for v in values))
        before, held = held, stored(added.join(jump, "above", "left").select("key", F.col("next").alias("above"), *values))
        current = held
        if before is not None:
            discard(before)
        step *= 2
    return current.drop("above")


def conversation_trie(conversations: DataFrame, fan_in: int = 64, flush_nodes: int = 200_000) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations.

    Conversation c begins with the first h turns of the conversation c - c % 100, h = crc32(c) % 6,
    and goes on with its own turns after its first h. Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by the digest of role and text; null role or text
    counts as empty; repeated rows are turns each; rows without conv_id belong to no conversation
    and are left out; very long texts are digested inside Spark's own expressions; other columns,
    whatever their names, are ignored; an empty table has no conversation, so no root: no rows.

    Node keys are the depth and a 127-bit polynomial of 128-bit digests of the turns: equal
    prefixes have equal keys, and different ones with chances beyond reach. A conversation, host
    or prefix of any size is spread: turns are sorted over all partitions, which carry on where the one
    before stopped; partitions combine their nodes before the merge. Nodes of a single
    conversation need no rollup, since everything below them is one path. The ids that end at
    one node are hashed by one task, as SHA-256 demands, which streams them.
    """
    turns = ordered_turns(conversations)
    partial = stored(partial_tries(turns, flush_nodes))
    nodes = stored(merged_nodes(partial.filter("ids IS NULL").drop("first_id", "ids"), fan_in))
    shared = nodes.filter("n > 1")
    per_parent = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.sum((F.col("n") == 1).cast("long")).alias("n_single")
    )
    begun = shared.join(per_parent, "key", "left").select(
        "key",
        "parent",
        "depth",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.col("n_single")).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("code_points")).alias("saved_tokens"),
    )
    begun = stored(begun)
    summed = subtree_sums(begun, ["n_leaves", "saved_tokens"]).join(begun.select("key", "n_children"), "key")
    single_leaf = nodes.filter("n = 1").join(per_parent.select("key", F.lit(1).alias("has_child")), "key", "left")
    tops = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("above_id"))
    rows = (
        single_leaf.select("key", "parent", "depth", "conv_id", "n", F.coalesce("has_child", F.lit(0)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        .unionByName(shared.select("key", "parent", "depth", "conv_id", "n").join(summed, "key"))
    )
    ends = end_digests(partial.filter("ids IS NOT NULL"))
    none = hashlib.sha256(b"").hexdigest()
    # Above a single conversation's node that is not shared stands the same conversation.
    return rows.join(tops, "parent", "left").join(ends, "key", "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("above_id", "conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
