"""Lookups in copies: what they read, sort and shuffle."""

from pyspark.sql import functions as F

from kgspark.jobs.demo import relation
from kgspark.model import LABEL, SAME_AS, TYPE, triples_of
from kgspark.operators import infer
from kgspark.sources import ordered, store

TEXT = "long text " * 60


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def graph_of(spark, path):
    own = [(f"http://a/e{i}", TYPE, "http://a/C", "iri") for i in range(90)] + [(f"http://a/e{i}", SAME_AS, f"http://b/e{i % 7}", "iri") for i in range(20)]
    rows = [*own, *[(f"http://b/e{i}", "http://a/p", f"http://a/e{i + 1}", "iri") for i in range(7)], ("http://d/x", "http://a/p", "http://b/e1", "iri"), ("http://c/t", SAME_AS, "http://a/e3", "iri"), ("http://c/t", LABEL, "T", "literal", None, "en"), ("http://a/e1", LABEL, TEXT, "literal")]
    store.insert(spark, path, triples_of(spark, rows))
    return store.read_store(spark, path)


def test_only_likely_triples_are_sorted_for_a_lookup(spark, tmp_path):
    path = str(tmp_path / "g")
    graph_of(spark, path)
    ordered.order(spark, path, bucket_rows=40)
    keys = spark.createDataFrame([("http://a/e2",), ("http://a/C",)], "k string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ordered.finder(spark, path)(keys, "k", "o")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "_word" in plan and found.count() == 91


def test_copies_are_written_without_a_sort_by_strings_and_name_predicates_of_long_objects(spark, tmp_path):
    path, name = str(tmp_path / "g"), "spark.sql.maxConcurrentOutputFileWriters"
    graph_of(spark, path)
    before = spark.conf.get(name)
    ordered.order(spark, path)
    assert spark.conf.get(name) == before
    for by in "so":
        place = ordered._place(store.manifest(spark, path)["layers"][0], by)
        state = ordered._state(spark, place)
        assert LABEL in state["long"] and len(state["long"]) < 4  # others only where hashes meet
        assert "Sort Columns" not in "".join(str(r) for r in spark.sql(f"DESCRIBE EXTENDED {ordered._name(place, state)}").filter("data_type <> '[]'").collect())


def test_frequent_keys_of_crowded_classes_are_counted_exactly(spark, monkeypatch):
    rows = spark.range(500).selectExpr("CASE WHEN id < 200 THEN 'hot' WHEN id < 240 THEN 'warm' ELSE CAST(id AS STRING) END AS o")
    for classes in (1, 8, 1 << 14):
        monkeypatch.setattr(ordered, "CLASSES", classes)
        counts = rows.groupBy(F.pmod(F.xxhash64("o"), F.lit(classes)).alias("class")).agg(F.count("*").alias("n"))
        got = ordered._frequent(rows, "o", counts, 30).join(rows.select("o", F.xxhash64("o").alias("h")).distinct(), "h").select("o", "parts")
        assert rows_of(got) == [("hot", 7), ("warm", 2)]


def test_relations_take_two_lookups_and_equal_scans(spark, tmp_path):
    path, asked = str(tmp_path / "g"), []
    graph = graph_of(spark, path)
    ordered.order(spark, path)
    own = ordered.finder(spark, path)

    def find(keys, key, by):
        asked.append(by)
        return own(keys, key, by)

    seeds = spark.createDataFrame([("http://a/e1",), ("http://a/e3",), ("http://a/e9",)], "entity string")
    up = spark.createDataFrame([("http://a/C", "http://a/C"), ("http://a/C", "http://a/Top")], "class string, ancestor string")
    for most, run in ((2, lambda f: infer.relations_with_sameas(graph, seeds, f)), (2, lambda f: infer.describe_with_inference(graph, seeds, up, f)), (1, lambda f: infer.relations_out_sameas(graph, seeds, f))):
        asked.clear()
        got = rows_of(run(find))
        assert got == rows_of(run(None)) and len(got) > 5 and len(asked) == most
    assert {r.source for r in infer.relations_with_sameas(graph, seeds, find).collect()} == {"direct", "sameAs-outgoing", "sameAs-incoming", "sameAs-as-object"}


def test_views_of_tables_are_not_named_as_copies(spark):
    relation(spark, "/root/testdata/sf0.001", "seeds")
    assert not [t for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith("kgspark_")]
