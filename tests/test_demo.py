"""The demo's saved graphs, made of narrow keys, equal their SQL, repeated source rows included."""

import pytest
from pyspark.sql import functions as F

from kgspark.jobs import demo
from kgspark.model import NS, SCHEMA, TRIPLE_COLUMNS, TYPE, triples_of
from kgspark.operators import ontology, validate
from kgspark.sources import store, writers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest tables with every row twice."""
    out = str(tmp_path_factory.mktemp("tables"))
    for t in demo.TABLES:
        rows = spark.read.parquet(f"{SMALL}/{t}.parquet")
        rows.unionByName(rows).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", ["graph", "external"])
def test_saved_relations_equal_their_sql(spark, repeated, name):
    want = demo.relation(spark, repeated, name).select(*TRIPLE_COLUMNS)
    got = demo.saved(spark, repeated, name).select(*TRIPLE_COLUMNS).cache()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_only_keys_are_shuffled(spark):
    plan = demo.parts(spark, SMALL, "graph")[SCHEMA + "owns"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    line = next(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert "hashpartitioning(k0" in line and "k1" in line


def test_loading_over_a_graph_is_refused(spark, tmp_path):
    rows = {"http://a/p:1": triples_of(spark, [("a", "http://a/p:1", "b", "iri")])}
    store.load(spark, str(tmp_path / "g"), rows)
    assert [tuple(r) for r in store.read_store(spark, str(tmp_path / "g")).collect()] == [("a", "http://a/p:1", "b", "iri", None, None)]
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "g"), rows)


def test_instances_are_counted_before_they_meet_the_table(spark):
    c, none = NS.ont + "Character", NS.ont + "Race"
    g = triples_of(spark, [("a", TYPE, c, "iri"), ("b", TYPE, c, "iri"), ("b", TYPE, c, "literal"), ("b", TYPE, "other", "iri")])
    classes = spark.createDataFrame([(c, "x"), (c, "y"), (none, "z")], "cls string, path string")
    df = ontology.with_instances(classes, "cls", g)
    assert {tuple(r) for r in df.collect()} == {(c, "x", 2), (c, "y", 2), (none, "z", 0)}


def test_whole_subjects_are_one_block_each(spark):
    hub = spark.range(writers.MOST_LINES + 5).select(F.lit("http://a/h&b").alias("s"), F.lit("http://a/p").alias("p"), F.format_string("%06d", "id").alias("o"), F.lit("literal").alias("o_kind"), *[F.lit(None).cast("string").alias(c) for c in ("o_dt", "o_lang")])
    turtle, node, element = (f(hub.repartition(4), None).collect() for f in (writers.to_turtle, writers.to_jsonld, writers.to_rdfxml))
    assert len(turtle) == len(node) == len(element) == 1
    assert turtle[0].block == "<http://a/h&b> " + " ;\n    ".join(f'<http://a/p> "{i:06d}"' for i in range(writers.MOST_LINES + 5)) + " ."
    assert node[0].node.startswith('{"@id":"http://a/h&b","http://a/p":[{"@value":"000000"},{"@value":"000001"}') and element[0].s == "http://a/h&b"
    assert element[0].element.startswith('<rdf:Description rdf:about="http://a/h&amp;b"><p:p xmlns:p="http://a/">000000</p:p>')


def test_entailed_triples_are_held_against_their_predicates_alone(spark, tmp_path, monkeypatch):
    c, plans = NS.ont + "Character", []
    rows = triples_of(spark, [("a", TYPE, c, "iri"), ("a", TYPE, c, "iri"), ("a", NS.prop + "realm", "Gondor", "literal")])
    rows.write.parquet(str(tmp_path / "g"))
    plain = validate.checkpointed
    monkeypatch.setattr(validate, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    made = validate.rdfs_materialize(spark.read.parquet(str(tmp_path / "g")), ontology.ontology_triples(spark))
    assert "In(p, [" in plans[1]  # the first round's; a filter on predicates reaches the scan
    assert {(r.s, r.p, r.o) for r in made.collect()} >= {("a", TYPE, c), ("a", TYPE, SCHEMA + "Person"), ("a", TYPE, NS.ont + "Location")} and made.count() == made.distinct().count()
