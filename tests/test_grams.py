import random

import pytest

from kgspark.model import LABEL, TYPE, triples_of
from kgspark.operators import explore
from kgspark.sources import grams, store

TERMS = ["ab", "ABC", "", "É a", "😀", "a😀b", "zzz", "c ", "bcab", "x" * 50]


def some_labels(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("abc éÉA😀B") for _ in range(rng.randrange(0, 9)))
    rows = [(f"http://a/e{rng.randrange(60)}", LABEL, text(), "literal", None, rng.choice([None, "en"])) for _ in range(n)]
    rows += [(f"http://a/e{i}", TYPE, "http://a/C", "iri") for i in range(20)] + [(f"http://a/l{seed}", LABEL, "abc" * 9000 + " The Ring", "literal")]
    return sorted(set((*r, *[None] * (6 - len(r))) for r in rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def check(spark, path, terms):
    held = [r for r in map(tuple, store.read_store(spark, path, [LABEL]).collect())]
    lower = {r[0]: r[1] for r in store.read_store(spark, path, [LABEL]).selectExpr("o", "lower(o)").distinct().collect()}
    for term in terms:
        assert rows_of(grams.labels_with(spark, path, term)) == sorted((r for r in held if term.lower() in lower[r[2]]), key=str), term


def test_searches_equal_scans(spark, tmp_path):
    path = str(tmp_path / "g")
    assert grams.labels_with(spark, path, "a").isEmpty() and grams.index_labels(spark, path) == 0
    store.insert(spark, path, triples_of(spark, some_labels(150, 1)))
    assert grams.index_labels(spark, path, slot_rows=20) == 1 and grams.index_labels(spark, path) == 0
    check(spark, path, TERMS)
    store.insert(spark, path, triples_of(spark, some_labels(60, 2)))
    check(spark, path, TERMS[:2])  # the new layer has no index yet
    store.remove(spark, path, store.read_store(spark, path, [LABEL]).filter("o LIKE 'a%' OR o LIKE '%c'"))
    check(spark, path, TERMS[:3])
    store.compact(spark, path)
    assert grams.index_labels(spark, path) == 1
    check(spark, path, TERMS[:2])
    store.drop(spark, path, [LABEL])
    assert grams.labels_with(spark, path, "a").isEmpty()


def test_a_search_reads_the_postings_of_its_term(spark, tmp_path):
    path = str(tmp_path / "g")
    store.insert(spark, path, triples_of(spark, some_labels(150, 1)))
    grams.index_labels(spark, path, slot_rows=20)
    out = grams.labels_with(spark, path, "Ring")
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan and "dynamicpruning" in plan  # the grams reach the scan; of the labels only slots with a hit are read
    assert "/labels" in str(out.inputFiles()) and all("/layers/" in f and "-grams/" in f for f in out.inputFiles())
    assert grams.labels_with(spark, path, "rinx").isEmpty() and not grams.labels_with(spark, path, "rinx").inputFiles()
    graph = store.read_store(spark, path)
    assert rows_of(explore.search_label(graph, "Ab", labels=grams.labels_with(spark, path, "Ab"))) == rows_of(explore.search_label(graph, "Ab"))


def test_a_broken_index_is_made_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    store.insert(spark, path, triples_of(spark, some_labels(40, 3)))
    with monkeypatch.context() as m:
        m.setattr(grams.json, "dumps", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            grams.index_labels(spark, path)
    assert grams.index_labels(spark, path) == 1
    check(spark, path, ["ab"])
