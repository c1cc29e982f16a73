import random

import pytest
from pyspark.sql import functions as F

from kgspark.model import SAME_AS, TRIPLE_COLUMNS, TYPE, triples_of
from kgspark.operators import infer
from kgspark.sources import ordered, store


def some_triples(n, seed):
    """Triples of which a third are instances of one class, with equivalences, literals that look like names, and languages."""
    rng = random.Random(seed)
    rows = [(f"http://a/e{i}", TYPE, "http://a/Hot", "iri") for i in range(n // 3)]
    for _ in range(n - n // 3):
        s, o = (f"http://a/e{rng.randrange(40)}" for _ in "so")
        rows.append(rng.choice([(s, "http://a/p", o, "iri"), (s, SAME_AS, o, "iri"), (s, "http://a/q", o, "literal", None, rng.choice(["en", None])), (s, "http://a/r 1", "it's é", "literal", "http://a/dt")]))
    return sorted(set((*r, *[None] * (6 - len(r))) for r in rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "g")
    store.insert(spark, path, triples_of(spark, some_triples(300, 1)))
    store.insert(spark, path, triples_of(spark, some_triples(120, 2)))
    return path


def same_as_scan(spark, path, keys):
    find, plain = ordered.finder(spark, path), ordered.scan(store.read_store(spark, path))
    for by in "so":
        want = rows_of(plain(keys, "k", by).select(*TRIPLE_COLUMNS, "k", "note"))
        assert rows_of(find(keys, "k", by).select(*TRIPLE_COLUMNS, "k", "note")) == want and want


def test_lookups_equal_scans(spark, path):
    keys = spark.createDataFrame([("http://a/Hot", 1), ("http://a/e3", 2), ("http://a/e3", 2), ("http://a/e5", 3), (None, 4), ("http://a/none", 5), ("it's é", 6)], "k string, note int")
    same_as_scan(spark, path, keys)  # without copies
    assert ordered.order(spark, path, bucket_rows=40) == 4 and ordered.order(spark, path) == 0
    same_as_scan(spark, path, keys)
    gone = store.read_store(spark, path).filter("o = 'http://a/Hot' AND s LIKE '%7'")
    assert gone.count() > 5
    held = gone.collect()
    store.remove(spark, path, gone)
    same_as_scan(spark, path, keys)
    store.insert(spark, path, spark.createDataFrame(held[:3], gone.schema))  # some are there again, in a layer without a copy
    same_as_scan(spark, path, keys)
    assert ordered.order(spark, path, by=("o",)) == 1
    store.drop(spark, path, ["http://a/p"])
    same_as_scan(spark, path, keys)
    store.compact(spark, path)
    same_as_scan(spark, path, keys)
    assert rows_of(ordered.finder(spark, path)(keys.limit(0), "k", "o")) == []


def test_a_hot_object_is_split_and_triples_stay_where_they_are(spark, path):
    ordered.order(spark, path, bucket_rows=40)
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("kgspark_")]
    salts = [spark.table(t).filter("o = 'http://a/Hot'").select("salt").distinct().count() for t in names]
    assert max(salts) >= 10
    keys = spark.createDataFrame([(f"http://a/e{i}",) for i in range(40)], "k string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = ordered.finder(spark, path)(keys, "k", "o")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2  # one of the keys for each layer


def test_a_few_names_reach_the_scan(spark, path):
    ordered.order(spark, path)
    out = ordered.having(spark, path, "o", ["http://a/Hot", "http://a/e1"])
    assert rows_of(out) == rows_of(store.read_store(spark, path).filter(F.col("o").isin("http://a/Hot", "http://a/e1")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o" in plan or "In(o, [" in plan


def test_a_session_that_does_not_know_the_copies(spark, path):
    ordered.order(spark, path, bucket_rows=40)
    keys = spark.createDataFrame([("http://a/Hot", 1), ("http://a/e3", 2)], "k string, note int")
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("kgspark_")]:
        spark.sql(f"DROP TABLE {t}")
    same_as_scan(spark, path, keys)


def test_inference_over_lookups(spark, path):
    ordered.order(spark, path, bucket_rows=40)
    graph, find = store.read_store(spark, path), ordered.finder(spark, path)
    seeds = spark.createDataFrame([("http://a/e1",), ("http://a/e7",), ("http://a/Hot",)], "entity string")
    up = spark.createDataFrame([("http://a/Hot", "http://a/Hot"), ("http://a/Hot", "http://a/Top")], "class string, ancestor string")
    assert rows_of(infer.describe(graph, seeds)) == rows_of(infer.describe(graph, seeds, find))
    assert rows_of(infer.relations_with_sameas(graph, seeds)) == rows_of(infer.relations_with_sameas(graph, seeds, find))
    assert rows_of(infer.describe_with_inference(graph, seeds, up)) == rows_of(infer.describe_with_inference(graph, seeds, up, find))
    assert rows_of(infer.relations_out_sameas(graph, seeds)) == rows_of(infer.relations_out_sameas(graph, seeds, find))
