"""Operators against brute force on small tables, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm.components import connected_components
from kgspark.llm.exact_dedup import exact_dedup
from kgspark.llm.lines import remove_shared_lines
from kgspark.llm.minhash import bands_for, near_duplicates
from kgspark.llm.mixing import mix_sources
from kgspark.llm.packing import ByteLevelEncoder, pack_documents
from kgspark.llm.quality import fit_quality, score_quality
from kgspark.llm.queries import ORACLE_SQL, op4_line_dedup, tokenizer_path
from kgspark.llm.spans import remove_repeated_spans, runs, sentences
from kgspark.llm.suffixes import Suffixes, remove_repeated_bytes
from kgspark.llm.topk import top_k
from kgspark.llm.toxicity import fit_toxicity, score_toxicity, strings_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, h1 long"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(3, 120)) for _ in range(40)]
    long = prose(rng, 6000)
    near = prose(rng, 200).split(" ")
    for i in range(12):
        changed = list(near)
        for _ in range(i):
            changed[rng.randrange(200)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(changed))
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 20)} {passage}. {prose(rng, 30)}" for _ in range(4)]
    texts += [texts[0], texts[0] + " ", texts[0].replace(" ", "\n"), long, long, None, None, "", " \t\n", "One two", "one TWO", "aaaa" * 600, "é" * 900]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or ""), -i, "r", 3) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_exact_dedup(docs, corpus, empty, bits):
    groups = {}
    for r in corpus:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    rows = exact_dedup(docs, filter_bits=bits).collect()
    assert len(rows) == len(corpus) and sum(r.kept for r in rows) == len(groups)
    best = {hashlib.sha256(k.encode()).hexdigest(): (min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))[0], len(v)) for k, v in groups.items()}
    assert all((r.keep_id, r.group_size) == best[r.text_sha256] for r in rows)
    assert exact_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(docs, filter_bits=100)


def test_mixing(docs, corpus, empty):
    rows = mix_sources(docs, carry=("row",)).collect()
    assert len(rows) == len(corpus) and {r.row for r in rows} == {"r", None}
    sizes = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    free, target, left = set(sizes), {}, float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
        left -= sum(3.0 * sizes[s] for s in over)
    by_size = {}
    for r in rows:
        by_size.setdefault(r.source_size, []).append(r)
        assert 0 <= r.copies <= 3
    for s, n in sizes.items():
        own = by_size[n]
        assert own[0].target == pytest.approx(target[s]) and abs(sum(r.copies * r.size for r in own) - target[s]) <= 3 * max(r.size for r in own)
    again = mix_sources(docs.repartition(3)).select("doc_id", "size", "copies")
    assert sorted(map(str, again.collect())) == sorted(map(str, mix_sources(docs).select("doc_id", "size", "copies").collect()))
    assert mix_sources(empty).count() == 0


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    ours, theirs = ByteLevelEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("", "  a  b", " x", "x ", "a\n b", "don't I'll we've'S", "　a 　b", "<|endoftext|> hi", "é\x1c x \x85 y", "tab\t x\r\n\r\n  y", "日本語 텍스트 12³ ½", "a" * 5000, "x<|endoftext|> <|endoftext|><|endoftext", "a" + " " * 4000 + "x", "a" + " \n" * 4000 + "\n7", "\t" * 3000 + "<|endoftext|>" + " " * 3000, "\u3000" * 2500 + "y" + "\x1c" * 2000 + "z"):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_encoder_on_runs_of_white_space():
    """Every class of white space, about the length from which runs are cut, at an end, before a special token and before text."""
    from tokenizers import Tokenizer

    ours, theirs = ByteLevelEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in range(0x1C, 0x20)]
    special = next(iter(ours.special))
    rng = random.Random(3)
    texts = [head + c * n + end for c in spaces for n in (999, 1000, 1001, 1002, 2000, 2001, 4100) for head in ("", "x") for end in ("", special, "a", "é!", special + "b")]
    texts += ["".join(rng.choice(["w", " ", "1", special]) + "".join(rng.choice(spaces[: rng.choice([2, 6, 25])]) for _ in range(rng.choice([1, 5, 1200]))) for _ in range(3)) for _ in range(100)]
    for text in texts:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_encoder_takes_very_long_runs():
    ours = ByteLevelEncoder(tokenizer_path())
    assert [len(ours.encode("a" + c * 3_000_000)) > 4 for c in " \n\u3000"] == [True] * 3
    for run in (" ", "\n", " \t", "x", "7", "!", "é"):
        text = "a " + run * (3_000_000 // len(run)) + "x"
        ids = np.frombuffer(ours.encode(text), "<u4").tolist()
        assert ours.bpe.decode_bytes(ids).decode() == text


@pytest.mark.parametrize("buffered", [500, 1 << 20])
def test_packing_round_trip(spark, corpus, empty, buffered):
    unique = {r[0]: r for r in corpus}
    docs = spark.createDataFrame(list(unique.values()), SCHEMA).repartition(3)
    rows = pack_documents(docs, tokenizer_path(), buffer_tokens=buffered, step_tokens=4096).collect()
    encoder = ByteLevelEncoder(tokenizer_path())
    for doc, r in unique.items():
        ids = np.append(np.frombuffer(encoder.encode(r[1] or ""), "<u4"), 1)
        own = sorted((x for x in rows if x.doc_id == doc), key=lambda x: x.start)
        assert [i for x in own for i in x.ids] == ids.tolist() and all(x.doc_tokens == len(ids) for x in own)
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].astype("<u4").tobytes()) for x in own)
    windows = {}
    for x in rows:
        windows.setdefault(x.sequence_id, []).append(x)
    for own in windows.values():
        own.sort(key=lambda x: x.offset)
        assert [x.offset for x in own] == [sum(y.length for y in own[:i]) for i in range(len(own))] and sum(x.length for x in own) == own[0].window <= 2048
    steps = {}
    for x in rows:
        steps[x.step_group] = steps.get(x.step_group, 0) + x.length
    assert max(steps.values()) <= 4096 and pack_documents(empty, tokenizer_path()).count() == 0


def test_shared_lines(spark, empty):
    rows = [(i, f"own {i}\n shared \n\nnear", f"s{i % 12}") for i in range(24)] + [(90, "near\nsolo", "s1"), (91, None, "s2"), (92, "", None), (93, "few", "s1"), (94, "few", "s2"), (0, "own 0\n shared \n\nnear", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("old"))
    out = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in remove_shared_lines(docs, most_sites=10).collect()}
    assert (3, "own 3\n", 4, 2) in out and (90, "solo", 2, 1) in out and (91, None, 0, 0) in out and (92, "", 1, 0) in out and (93, "few", 1, 0) in out
    assert remove_shared_lines(docs, most_sites=10).count() == len(rows) and remove_shared_lines(empty).count() == 0


def test_shared_lines_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, f"own {i}\n shared \n\nnear", f"s{i % 12}") for i in range(24)] + [(91, None, "s2"), (92, "", None), (None, "near\nx", None), (0, "own 0\n shared \n\nnear", "s0")]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(folder)
    own = [tuple(r) for r in op4_line_dedup(spark, str(tmp_path)).collect()]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    assert sorted(own, key=str) == sorted(connection.execute(ORACLE_SQL["op4_line_dedup"]).fetchall(), key=str) and len(own) == len(rows)


def test_repeated_spans(docs, corpus, empty, spark):
    for r in corpus:
        assert "".join(sentences(r[1] or "")) == (r[1] or "")
    rng = random.Random(1)
    passage = ". ".join(prose(rng, 15) for _ in range(4)) + "."
    texts = [(i, f"Own start {prose(rng, 30)} {passage.capitalize()} {prose(rng, 9)}") for i in range(5)] + [(9, "Clean text here. " + prose(rng, 40)), (10, None), (11, "")]
    out = {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    body = passage.split(". ")[2]
    assert body in out[0].text and all(body not in out[i].text and out[i].n_removed >= 3 for i in range(1, 5))
    assert out[9].text == texts[5][1] and out[10].text is None and out[11].text == "" and out[1].text.startswith("Own start")
    assert remove_repeated_spans(docs).count() == len(corpus) and remove_repeated_spans(empty).count() == 0


def test_repeated_spans_against_brute_force(spark, corpus):
    """All runs of all documents in one dictionary; the first place by (id, nulls last, text hash) stays."""
    rng = random.Random(12)
    pool = [prose(rng, rng.randrange(1, 30)).capitalize() + rng.choice([". ", "! ", "\n"]) for _ in range(60)]
    rows = [(i if i % 9 else None, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(120)] + [(5, pool[3] + pool[4] + pool[5]), (5, pool[3] + pool[4] + pool[6]), (7, None), (None, None)]
    rows += [(r[0], r[1]) for r in corpus]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "gone": F.lit("g"), "n_removed": F.lit("old")}).repartition(4)
    print_ = {r.text: r.p for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    place = lambda i, t: (i is None, i or 0, print_[t])
    first = {}
    for i, t in rows:
        for a, b, digest in runs(sentences(t or ""), 2, 12, 25):
            first[digest] = min(first.get(digest, (True, 1 << 62, 0)), place(i, t))
    wanted = []
    for i, t in rows:
        parts, gone, seen = sentences(t or ""), set(), set()
        for a, b, digest in runs(parts, 2, 12, 25):
            if digest in seen or place(i, t) > first[digest]:
                gone |= set(range(a, b))
            seen.add(digest)
        wanted.append(str((i, t if t is None else "".join(p for k, p in enumerate(parts) if k not in gone), len(parts), len(gone))))
    out = remove_repeated_spans(docs)
    assert out.columns == ["doc_id", "text", "doc", "gone", "n_sentences", "n_removed"]
    assert sorted(str((r.doc_id, r.text, r.n_sentences, r.n_removed)) for r in out.collect()) == sorted(wanted)


def test_whole_repeated_passages_go(spark):
    rng = random.Random(8)
    for sizes in ([30, 22], [22, 30], [30, 5], [4, 9, 3], [9, 2, 3], [40, 3, 30, 2], [1, 1, 30, 1, 1]):
        passage = [prose(rng, n).capitalize() + "." for n in sizes]
        texts = [f"Own start {prose(rng, 30)}. {' '.join(passage)} Own end {prose(rng, 30)}." for _ in range(3)]
        out = {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert out[0].text == texts[0] and out[0].n_removed == 0
        assert all(s not in out[i].text for s in passage for i in (1, 2)), sizes
        assert all(out[i].n_removed == len(sizes) and out[i].text == texts[i].replace(" ".join(passage) + " ", "") for i in (1, 2)), sizes


def test_runs_cover_every_passage():
    rng = random.Random(9)
    for _ in range(200):
        parts = [" ".join("w" * rng.randrange(0, 2) + str(rng.random()) for _ in range(rng.choice([0, 1, 2, 5, 11, 13, 24, 25, 40]))) + " " for _ in range(9)]
        made = [(a, b) for a, b, _ in runs(parts, 2, 12, 25)]
        assert len(made) == len(set(made)) and made == sorted(made, key=lambda r: (r[1], r[0]))
        for i in range(9):
            for j in range(i + 1, 10):
                count = [len(p.split()) for p in parts[i:j] if p.split()]
                if count and (len(count) >= 2 and sum(count) >= 12 or sum(count) >= 25):
                    inside = {k for a, b in made if i <= a and b <= j for k in range(a, b)}
                    assert {k for k in range(i, j) if parts[k].split()} <= inside


def brute_bytes(texts, length):
    counts = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            counts[b[i : i + length]] = counts.get(b[i : i + length], 0) + 1
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)


@pytest.mark.parametrize("members", [1, 6, 16_384])
def test_repeated_bytes(spark, docs, corpus, empty, members):
    wanted = sorted(map(str, brute_bytes([r[1] for r in corpus], 80)))
    rows = remove_repeated_bytes(docs, length=80, gram=32, most_members=members).collect()
    assert sorted(str((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rows) == wanted
    assert remove_repeated_bytes(empty).count() == 0


def test_suffix_sort():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(700)) + b"a" * 60
    data = np.frombuffer(text, np.uint8)
    first = np.array(sorted(rng.sample(range(len(text)), 300)))
    past = np.minimum(first + 50, len(text))
    made = Suffixes(data, first, past)
    strings = [text[a:b] for a, b in zip(first, past)]
    assert [strings[i] for i in made.order] == sorted(strings)
    made._plainly()
    assert [strings[i] for i in made.order] == sorted(strings)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(1000, [1.0] * 8), (1001, [1.0] * 8), (2000, [float("nan")] + [0.0] * 7), (2001, None), (2002, [None] * 8), (2003, [float("inf")] * 8), (2100, []), (300000, [1.0, 2.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    good = {i: np.floor(np.array(np.array(v, np.float32), np.float64) * 1024) for i, v in vectors if v and len(v) == 8 and None not in v and np.isfinite(v).all()}
    wanted = set()
    for q in [i for i in good if i % 100 == 0]:
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:10]
        wanted |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    for shard in (37, 10_000):
        assert {tuple(r) for r in top_k(table, shard_rows=shard, query_rows=3).collect()} == wanted
    assert top_k(table.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 3, 5]) for _ in range(4)]) for i in range(300)] + [(400, [1e300] * 4), (401, [-1e300] * 4), (402, [1.7e308] * 4)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("shard", F.lit(None))
    good = {i: [int(np.floor(x * 1024)) for x in v] for i, v in vectors if i != 402}
    wanted = set()
    for q in [i for i in good if i % 100 == 0]:
        scores = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(good[q], v)))) for i, v in good.items() if i != q}
        wanted |= {(q, k, i, scores[i]) for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:10], 1)}
    for shard in (37, 10_000):
        assert {tuple(r) for r in top_k(table, shard_rows=shard).collect()} == wanted


def test_near_duplicates(docs, corpus, empty):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()

    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    reach = {i: i for i in sets}

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                reach[y] = x
    for block in (2, 1024):
        rows = near_duplicates(docs, percent=85, block=block).collect()
        assert len(rows) == len(corpus)
        assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id) for r in rows if r.doc_id is not None)
    assert near_duplicates(empty).count() == 0
    assert bands_for(0.85, 200) == (33, 6) and bands_for(0.8, 200) == (40, 5)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    reach = {}
    for a, b in edges:
        if a != b:
            reach.setdefault(a, set()).add(b)
            reach.setdefault(b, set()).add(a)
    wanted = {}
    for n in sorted(reach):
        stack = [n] if n not in wanted else []
        while stack:
            x = stack.pop()
            if x not in wanted:
                wanted[x] = n
                stack += reach[x]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(wanted) and {r.node: r.component for r in found} == wanted


def test_classifiers(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad, rude = i % 3 == 0, i % 4 == 0
        words = prose(rng, rng.randrange(20, 60)).split(" ")
        if rude:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["blorkish", "zquanto", "zquanty"])
        rows.append((i, "!!! ".join(words).upper() if bad and not rude else " ".join(words)))
        labels.append((i, int(not (bad and not rude)), int(rude)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "b l o r k i s h " + prose(rng, 20)), (903, "zqu.anto " + prose(rng, 20))], "doc_id long, text string")
    labelled = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    quality = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labelled)).collect()}
    assert len(quality) == 604 and all((quality[i] >= 0.5) == bool(q) for i, q, _ in labels if i in held) and 0 <= quality[900] <= 1
    toxic = {r.doc_id: r.score for r in score_toxicity(docs, fit_toxicity(docs, labelled)).collect()}
    right = np.mean([(toxic[i] >= 0.7) == bool(t) for i, _, t in labels if i in held])
    assert right > 0.97 and toxic[902] > 0.7 and toxic[903] > 0.7 and toxic[901] < 0.5
    none = labelled.limit(0)
    assert {r.score for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    assert max(r.score for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()) < 0.5
    assert score_quality(empty, fit_quality(empty, none)).count() == 0 and score_toxicity(empty, fit_toxicity(empty, none)).count() == 0
    assert "idiot" in strings_of("an I d i o t x.") or "idiotx" in strings_of("an I d i o t x.")


def test_spelled_words_are_joined():
    for text in ("an i - d - i - o - t.", "an i  d i   o t", "an i d. i * o\n\nt"):
        assert any("idiot" in s for s in strings_of(text)), text


def test_quality_reads_words(spark):
    rng = random.Random(6)
    words = {kind: ["".join(rng.choice("bcdfghklmnprst") for _ in range(n)) for n in range(3, 9) for _ in range(15)] for kind in (0, 1)}
    rows = []
    for i in range(600):
        shape = [rng.randrange(90) for _ in range(rng.randrange(20, 60))]  # words of both kinds have the same lengths
        rows.append((i, " ".join(words[i % 2][j] for j in shape)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS quality"))).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == bool(i % 2) for i in held]) > 0.97


def test_near_duplicates_without_own_ids_go(spark):
    import corpus_pipeline

    rng = random.Random(7)
    one, two, three, four = (prose(rng, 60) for _ in range(4))
    rows = [(5, one), (5, one), (None, one), (3, one + " tail"), (7, two), (7, three), (None, two), (None, four), (None, four), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(3, one + " tail"), (7, two), (7, three), (None, four), (None, None)]))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, prose(rng, 40) + ("\nshared line of all" if i % 5 else ""), "en", f"s{i % 12}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s1", 0) for i in range(5)] + [(200 + i, "BUY!! " * 40, "en", "s2", 0) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if name == "quality classifier":
            assert docs.filter("doc_id >= 200").count() == 0 and docs.count() == 65
        if name == "line dedup":
            assert docs.filter("text LIKE '%shared line of all'").count() == 0 and docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "MinHash near-dedup":
            assert docs.filter("doc_id >= 100").count() == 0 and docs.count() == 60
    assert docs.agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


@pytest.mark.parametrize("full", [True, False])
def test_pipeline_on_odd_rows(spark, tmp_path, full):
    """Nulls in any column, empty texts, repeated rows, clashing column names; and an empty table."""
    import corpus_pipeline

    rng = random.Random(3)
    good = [(i, prose(rng, 30), "en", f"s{i % 3}", 0) for i in range(30)]
    rows = good + [good[4], good[4], (None, good[5][1], None, None, None), (None, prose(rng, 30), None, None, None), (40, None, "en", "s1", 0), (41, "", "en", None, 0), (42, prose(rng, 9000), "en", "s1", 0)]
    rows += [(60 + i, "BUY!! " * 40, "en", "s2", 0) for i in range(20)]
    clashing = {c: F.lit("x") for c in ("row_key", "copies", "copy", "score", "id", "text_key", "gone", "split", "size", "component_id")}
    table = spark.createDataFrame(rows if full else [], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clashing)
    spark.createDataFrame([(r[0], int(r[0] < 60)) for r in rows if r[0] is not None and full], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if not full:
            assert docs.count() == 0
        elif name == "quality classifier":
            assert {r[1] for r in good} <= {r.text for r in docs.collect()} and docs.filter("doc_id >= 60").count() == 0
        elif name == "MinHash near-dedup":
            texts = [r.text for r in docs.collect() if r.text]
            assert len(texts) == len(set(texts)) and {r[1] for r in good} <= set(texts)
            assert docs.filter("doc_id IS NULL AND text <> ''").count() == 1
