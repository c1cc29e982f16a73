"""Adding to a saved graph: what is shuffled, and that nothing is lost or doubled."""

from kgspark.model import LABEL, SAME_AS, TRIPLE_COLUMNS, TYPE, triples_of
from kgspark.operators import infer
from kgspark.sources import store

TEXT = "long text " * 60
#: 200 characters in 400 bytes: not long, as characters count.
ACCENTS = "é" * 200


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.select(*TRIPLE_COLUMNS).collect()), key=str)


def held(spark, path):
    rows = [("http://a/s", TYPE, "http://a/C", "iri"), ("http://a/s", LABEL, TEXT, "literal", None, "en"), ("http://a/s", LABEL, ACCENTS, "literal"), ("http://a/s", LABEL, "S", "literal", None, "en")]
    store.load(spark, path, {p: triples_of(spark, [r for r in rows if r[1] == p]) for p in (TYPE, LABEL)})
    return triples_of(spark, rows)


def more(spark):
    labels = [("http://a/s", LABEL, TEXT, "literal", None, "en"), ("http://a/s", LABEL, TEXT, "literal"), ("http://a/s", LABEL, TEXT, "literal"), ("http://a/s", LABEL, TEXT + "!", "literal", None, "en"), ("http://a/s", LABEL, ACCENTS, "literal"), ("http://a/t", LABEL, "T", "literal"), ("http://a/t", LABEL, "T", "literal")]
    return triples_of(spark, labels), triples_of(spark, [("http://a/s", SAME_AS, "http://b/s", "iri")])


def test_sets_are_added_to_a_graph_by_predicate(spark, tmp_path):
    path = str(tmp_path / "g")
    before, (labels, same) = held(spark, path), more(spark)
    after = store.load(spark, path, {LABEL: labels, SAME_AS: same})
    assert after["version"] == 2 and [x["predicates"] for x in after["layers"][1:]] == [[SAME_AS], [LABEL]]
    assert rows_of(store.read_store(spark, path)) == rows_of(before.unionByName(labels).unionByName(same).dropDuplicates())
    assert store.predicates(spark, path) == sorted([LABEL, SAME_AS, TYPE])
    store.load(spark, path, {LABEL: labels, SAME_AS: same})  # all of it is there
    assert store.read_store(spark, path).count() == 8


def test_texts_are_compared_by_digest_and_only_new_ones_move(spark, tmp_path):
    path = str(tmp_path / "g")
    before, (labels, _) = held(spark, path), more(spark)
    lacks, has = store._present(spark, path, labels, "left_anti"), store._present(spark, path, labels, "left_semi")
    assert rows_of(lacks) == rows_of(labels.subtract(before)) and lacks.count() == 3
    assert rows_of(has) == rows_of(labels.intersect(before)) and has.count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(store._present(spark, path, labels, "left_anti"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "sha2" in text and "_word" in text and "LeftSemi" not in text  # a semi-join would be pushed down before the filter
    store.remove(spark, path, labels)
    assert rows_of(store.read_store(spark, path)) == rows_of(before.subtract(labels))
    store.insert(spark, path, labels)
    assert rows_of(store.read_store(spark, path)) == rows_of(before.unionByName(labels).dropDuplicates())


def test_types_of_seeds_are_filtered_before_they_are_shuffled(spark):
    graph = triples_of(spark, [(f"http://a/e{i}", TYPE, "http://a/C", "iri") for i in range(9)])
    seeds = spark.createDataFrame([("http://a/e1",), ("http://a/e1",), ("http://a/e7",)], "entity string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        types = infer._types(graph, seeds)
        text = plan(types)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" not in text and "_word" in text and sorted(map(tuple, types.collect())) == [("http://a/e1", "http://a/C"), ("http://a/e7", "http://a/C")]
