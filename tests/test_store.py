import os

import pytest
from pyspark.sql import functions as F

from kgspark.model import LABEL, TYPE, triples_of
from kgspark.sources import store

ROWS = [("http://a/s", TYPE, "http://a/C", "iri"), ("http://a/s", LABEL, "S", "literal", None, "en"), ("http://a/s", LABEL, "S", "literal"), ("http://a/t", "http://a/p?x=1&y#z", "http://a/s", "iri")]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def full(row):
    return (*row, *[None] * (6 - len(row)))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_insert_and_delete_write_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "g")
    assert store.read_store(spark, path).count() == 0
    store.insert(spark, path, triples_of(spark, [*ROWS, ROWS[0]]))
    assert rows_of(store.read_store(spark, path)) == sorted(map(full, ROWS), key=str)
    before = files(path)
    after = store.insert(spark, path, triples_of(spark, [ROWS[0], ("http://a/u", TYPE, "http://a/C", "iri")]))
    assert after["layers"][-1]["predicates"] == [TYPE] and before < files(path)
    assert sum(spark.read.parquet(f).count() for f in files(path) - before) == 1  # what was there isn't written again
    after = store.remove(spark, path, triples_of(spark, [ROWS[2], ("http://a/none", LABEL, "x", "literal")]))
    assert after["layers"][-1] | {"folder": 0} == {"seq": 3, "kind": "gone", "folder": 0, "predicates": [LABEL]}
    left = [r for r in [*ROWS, ("http://a/u", TYPE, "http://a/C", "iri")] if r != ROWS[2]]
    assert rows_of(store.read_store(spark, path)) == sorted(map(full, left), key=str)
    store.insert(spark, path, triples_of(spark, [ROWS[2]]))  # after its deletion it is there again
    assert rows_of(store.read_store(spark, path, [LABEL])) == sorted(map(full, ROWS[1:3]), key=str)
    assert rows_of(store.read_store(spark, path, version=1)) == sorted(map(full, ROWS), key=str)


def test_compaction_leaves_other_predicates(spark, tmp_path):
    path = str(tmp_path / "g")
    store.insert(spark, path, triples_of(spark, ROWS))
    store.remove(spark, path, triples_of(spark, ROWS[1:2]))
    held = rows_of(store.read_store(spark, path))
    before = files(path)
    layers = store.compact(spark, path)["layers"]
    assert rows_of(store.read_store(spark, path)) == held and layers[-1]["predicates"] == [LABEL] and layers[0]["predicates"] == sorted([TYPE, ROWS[3][1]])
    assert all("label" in f for f in files(path) - before) and store.compact(spark, path)["version"] == 3
    typed = store.read_store(spark, path).filter(F.col("p") == TYPE)
    assert typed.count() == 1 and "PartitionFilters: [" in typed._jdf.queryExecution().toString()


def test_a_broken_write_leaves_the_graph(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    store.insert(spark, path, triples_of(spark, ROWS))
    held = rows_of(store.read_store(spark, path))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.insert(spark, path, triples_of(spark, [("http://a/x", TYPE, "http://a/D", "iri")]))
    assert rows_of(store.read_store(spark, path)) == held
    stale = store.manifest(spark, path)
    store.insert(spark, path, triples_of(spark, [("http://a/x", TYPE, "http://a/D", "iri")]))
    with pytest.raises(RuntimeError):
        store._commit(spark, path, stale, stale["layers"])  # another writer was faster
    assert store.read_store(spark, path).count() == len(ROWS) + 1


def test_drop_and_branch(spark, tmp_path):
    path, copy = str(tmp_path / "g"), str(tmp_path / "copy")
    store.insert(spark, path, triples_of(spark, ROWS))
    store.branch(spark, path, copy)
    store.drop(spark, copy, [LABEL])
    assert store.read_store(spark, copy).count() == 2 and store.read_store(spark, path).count() == 4
    store.drop(spark, copy)
    assert store.read_store(spark, copy).count() == 0 and not files(copy) and store.read_store(spark, path).count() == 4
