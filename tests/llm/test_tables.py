"""Decontamination, the conversation trie and the filter audit against brute force, with odd rows and hot groups."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from kgspark.llm.audit import audit_filters, mask_cells
from kgspark.llm.decontaminate import contaminated_spans, decontaminate
from kgspark.llm.trie import conversation_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string, mask int"
SPACE = r"[^\x20\x09-\x0D]+"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items):
    grams = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w, hit, names = words_of(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (found := grams.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    names |= found
        out.append((doc, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["Alpha", "beta", "gäm", "x1", "rho", "ÉTÉ", "Zeta"]) + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(30)]
    items += [(30, "Only Three words"), (31, "one"), (32, ""), (33, None), (None, items[3][1]), (34, items[3][1]), (3, items[3][1]), (35, "--- !!!")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            _, passage = rng.choice(items[:30])
            cut = passage.split(" ")[rng.randrange(4) :]
            text[rng.randrange(len(text) + 1) : 0] = [rng.choice(["-", "", "\n"]).join([" ", " "]).join(cut)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    half = items[0][1].split(" ")
    docs += [(60, " ".join(half[:5])), (61, " ".join(half[5:])), (62, "  only THREE-words. " + "ONE"), (63, None), (64, ""), (65, items[3][1].upper().replace("Ä", "ä"))]
    docs += [(None, items[1][1]), (66, (items[2][1] + " . ") * 300), docs[0], (67, "x" * 200_000 + " one")]
    rows = [(d, t, "en", None, 1, 7, "s", 3) for d, t in docs]
    return rows, items, spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, gram int")


@pytest.mark.parametrize("slice_bytes", [64 << 20, 20_000])
def test_contamination(leaks, slice_bytes):
    rows, items, docs, benchmark = leaks
    got = contaminated_spans(docs, benchmark, slice_bytes=slice_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.past - s.first for s in r.spans), r["items"]) for r in got), key=repr) == contamination(rows, items)
    for r in got:
        raw = (r.text or "").encode()
        assert sum((words_of(raw[s.first_byte : s.past_byte].decode()) for s in r.spans), []) == [w for s in r.spans for w in words_of(r.text)[s.first : s.past]]


def test_decontaminate(leaks, spark):
    rows, items, docs, benchmark = leaks
    want = contamination(rows, items)
    clean = decontaminate(docs, benchmark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_hit, len(words_of(r.text))) for r in clean) == sorted((d is None, d or 0, h, n - h) for d, n, h, _ in want)
    assert {r.doc_id: r.text for r in clean}[63] is None and {r.doc_id: r.text for r in clean}[62] == "  "  # spans that adjoin are one
    assert sorted(r.doc_id for r in decontaminate(docs, benchmark, whole_documents=True).collect()) == sorted(d for d, _, h, _ in want if not h)
    assert decontaminate(docs.limit(0), benchmark).count() == 0
    assert {r.n_hit for r in decontaminate(docs, benchmark.limit(0)).collect()} == {0}


def trie(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest())
    convs = {c: [(r, x) for _, _, r, x in sorted(turns, key=key)] for c, turns in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        host = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(convs.get(host, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, sums = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        members, below = nodes[p], children.get(p, [])
        saved = (len(members) - 1) * (len(p[-1][1]) if p else 0) + sum(sums[b][1] for b in below)
        sums[p] = (sum(sums[b][0] for b in below) or 1, saved)
        ends = ",".join(map(str, sorted(c for c, last in members if last)))
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in members), len(p), -1 if parent is None else parent, len(members), len(below), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, n int, host long"


def conversations(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONVERSATIONS).repartition(parts)


def trie_rows(spark, rows, **options):
    return sorted((r.conv_id, r.depth, -1 if r.depth == 0 else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in conversation_trie(conversations(spark, rows), **options).collect())


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def odd_conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), *range(-130, -90), -1, -2]:
        own = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "naïve 🙂", "", None])) for t in range(rng.randrange(1, 9))]
        rows += own
    rows += [(300 + c, t, "user", f"same {t}") for c in range(60) for t in range(7)]  # copies
    rows += [(100, None, "user", "before all"), (101, 0, "user", "tied"), (101, 0, "user", "also tied"), (101, 0, "user", "tied"), (None, 0, "user", "of none"), rows[5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"fan_in": 2, "flush_nodes": 5}])
def test_trie(uncoalesced, options):
    rows = odd_conversations()
    assert trie_rows(uncoalesced, rows, **options) == trie(rows)


def test_trie_of_conversations_over_many_partitions(uncoalesced):
    """A host and its copy that hold most rows span several partitions; the trie is deep there."""
    rows = [(c, t, "user", f"turn {t}" if t % 50 or c < 402 else "else") for c in (400, 401, 402, 403) for t in range(200)]
    rows += [(c, t, "bot", "short") for c in range(404, 410) for t in range(2)] + [(399, 0, "bot", "x")]
    for parts in (4, 9):
        uncoalesced.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert trie_rows(uncoalesced, rows) == trie(rows)
        finally:
            uncoalesced.conf.set("spark.sql.shuffle.partitions", 4)


def test_trie_of_little(spark):
    assert trie_rows(spark, []) == []
    one = [(1, 0, "user", "alone" * 50_000)]
    assert trie_rows(spark, one) == trie(one)


def audit(docs, labels):
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    parts = {}
    for d, text, lang, *_ in docs:
        text = text or ""
        w = re.findall(SPACE, text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > first[text]}
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out, shapley = [], {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in rows if f in r[0]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
    return sorted(tuple([*r, shapley[r[0], r[1][r[2] - 1]]]) for r in out)


def test_filter_audit(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["Aa", "bee", "CC", "dé", "e|", "f"]) + str(rng.randrange(90))
    docs = []
    for i in range(150):
        text = " ".join(word() for _ in range(rng.choice([5, 99, 100, 101, 150])))
        if i % 3 == 0:
            text = text.replace("|", "").lower()
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[3][1], rng.choice(["en", "fr"])) for i in range(80)]  # copies in several parts
    docs += [(300, None, "en"), (301, "", None), (302, " \t", "en"), (None, docs[3][1], "en"), (None, "free", "en"), (303, "free", "en"), docs[7], docs[7], (304, "\x85\xa0a " * 100, "en"), (305, "Long words " * 50_000, "en")]
    labels = [(i, i // 2 % 2, int(i % 5 == 0)) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "s", 1, 2, "x", 9) for d in docs], DOCS).repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    got = audit_filters(mask_cells(table, marked))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == audit(docs, labels)
    assert audit_filters(mask_cells(table.limit(0), marked)).count() == 0
    assert mask_cells(table, marked.limit(0)).agg(F.sum("n_good")).first()[0] == 0
