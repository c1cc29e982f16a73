"""What may not grow faster than the input: rows that no key is like stay where they are, texts aren't copied, repeats aren't sent."""

from kgspark import queries
from kgspark.functions.wikitext import parse_pages
from kgspark.model import LABEL, SAME_AS, TRIPLE_COLUMNS, TYPE, added, likely, triples_of
from kgspark.operators import enrich, explore, generate, infer, validate
from kgspark.sources import grams, ordered, readers, store, writers

TEXT = "long text " * 60


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def small(spark):
    own = [(f"http://a/e{i}", TYPE, "http://a/C", "iri") for i in range(30)] + [(f"http://a/e{i}", LABEL, f"name {i}", "literal", None, "en") for i in range(30)]
    return triples_of(spark, [*own, ("http://a/e1", LABEL, TEXT, "literal"), ("http://a/e2", SAME_AS, "http://a/e3", "iri")])


def test_likely_rows_hold_all_matches_and_the_rest_none(spark):
    rows, keys = spark.range(3000).selectExpr("CAST(id AS STRING) AS a", "id % 3 AS g"), spark.range(0, 3000, 60).selectExpr("CAST(id AS STRING) AS k", "id % 3 AS g")
    for bits, within in ((64, ()), (1 << 20, ()), (1 << 12, ("g",))):
        met, rest = likely(rows, "a", keys, "k", bits, within), likely(rows, "a", keys, "k", bits, within, rest=True)
        assert rows_of(met.unionByName(rest)) == rows_of(rows) and met.join(keys, met.a == keys.k, "left_semi").count() == 50
    assert likely(rows, "a", keys, "k").count() == 50 and likely(rows, "a", keys.limit(0), "k").isEmpty()


def test_lookups_shuffle_only_likely_rows(spark):
    graph, seeds = small(spark), spark.createDataFrame([("http://a/e2",)], "entity string")
    for df in (infer.describe(graph, seeds), infer.relations_with_sameas(graph, seeds), explore.entity_page(graph, seeds), explore.exists(graph, seeds, {"x": [TYPE]})):
        assert "_word" in plan(df)
    assert {r.source for r in infer.relations_with_sameas(graph, seeds).collect()} == {"direct", "sameAs-outgoing"}


def test_copies_hold_no_texts_and_lookups_find_them(spark, tmp_path):
    path = str(tmp_path / "g")
    store.insert(spark, path, small(spark))
    before = {t.name for t in spark.catalog.listTables()}
    assert ordered.order(spark, path) == 2
    made = [t.name for t in spark.catalog.listTables() if t.name not in before]
    assert len(made) == 2 and all(spark.table(t).filter("length(o) > 256").isEmpty() for t in made)
    keys, scan = spark.createDataFrame([(TEXT,), ("http://a/e1",), ("http://a/C",)], "k string"), ordered.scan(store.read_store(spark, path))
    for by, n in (("s", 3), ("o", 31)):
        found = ordered.finder(spark, path)(keys, "k", by)
        assert rows_of(found) == rows_of(scan(keys, "k", by).select(found.columns)) and found.count() == n


def test_postings_lie_where_their_labels_are(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    store.insert(spark, path, small(spark))
    monkeypatch.setattr(grams, "TASK_CHARS", 200)
    grams.index_labels(spark, path)
    files = grams.labels_with(spark, path, "ame").inputFiles()
    assert len({f.rsplit("part-", 1)[1][:5] for f in files if "/postings/" in f}) > 1  # a frequent gram is spread over the tasks that hold its labels
    assert grams.labels_with(spark, path, "ame 1").count() == 11 and grams.labels_with(spark, path, "xt Long").count() == 1


def test_deletion_strings_that_nothing_meets_are_not_shuffled(spark):
    names = spark.createDataFrame([("supplier#000000001",), ("gandalf",)], "name string")
    own = names.selectExpr("name", "name AS a", "length(name) AS na").withColumn("ha", enrich._histogram(names.name))
    other = spark.createDataFrame([("gandalff", 1), ("nobody furniture", 2)], "b string, pos int").selectExpr("*", "length(b) AS nb")
    pairs = enrich._fuzzy_pairs(own, other.withColumn("hb", enrich._histogram(other.b)), 0.9, 3)
    assert "_word" in plan(pairs) and [tuple(r) for r in pairs.collect()] == [("gandalf", "gandalf", "gandalff", 1)]


def test_shapes_count_targets_and_values_in_one_aggregation(spark):
    shapes = spark.createDataFrame([("http://a/C", LABEL, "maxCount", "1"), ("http://a/C", SAME_AS, "minCount", "1"), ("http://a/C", SAME_AS, "nodeKind", "iri"), ("http://a/D", LABEL, "minCount", "1")], "target_class string, path string, constraint string, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = validate.shacl_validate(small(spark), shapes)
        assert "LeftOuter" not in plan(out)
        got = rows_of(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r for r in got if r[2] == "maxCount"] == [("http://a/e1", LABEL, "maxCount", "1")] and len(got) == 30


def test_deletes_shuffle_once_and_leave_the_rest_unshuffled(spark, tmp_path):
    path, graph = str(tmp_path / "g"), small(spark)
    store.insert(spark, path, graph)
    gone = graph.filter("s LIKE '%3'")
    assert "Join" not in plan(store._present(spark, path, gone.unionByName(gone), "left_semi"))
    store.remove(spark, path, gone.unionByName(gone).unionByName(triples_of(spark, [("http://a/none", TYPE, "http://a/C", "iri")])))
    assert rows_of(store.read_store(spark, path)) == rows_of(graph.filter("s NOT LIKE '%3'").select(*TRIPLE_COLUMNS)) and "_word" in plan(store.read_store(spark, path))


def test_exports_may_be_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "MOST_FILE_LINES", 10)
    writers.export_graph(small(spark).coalesce(1), str(tmp_path / "out"), "nt", "gzip")
    assert len(list((tmp_path / "out").glob("*.txt.gz"))) == 7
    assert rows_of(readers.read_ntriples(spark, str(tmp_path / "out"))) == rows_of(small(spark))


RICH = """{{Quote|x}} {{Infobox %s | name = '''[[A|The A]]''' | othernames = B<br/>See below | gender = Male | race = [[Elves|elf]] | people = Noldor | birth = {{TA|5}} | death = {{FA|1}}
| birthlocation = [[Here]] | deathlocation = [[There]] | spouse = [[S]], [[S]] | children = [[None]] [[C]] | parentage = [[P]] | siblings = [[Q]] | location = [[L]], [[M]] | realm = [[R]] | founded = {{SA|2}}
| destroyed = TA 9 | description = A ''land'' | type = ring | owner = [[O]], [[O]] | creator = [[K]] | maker = [[K]] | date = TA 3 | result = won | outcome = lost | image = File:A.jpg | other = [[Z]] {{TA|1}} }}"""


def rich(spark):
    pages = [(f"Page {i}", RICH % kind) for i, kind in enumerate(("character", "place", "weapon", "battle", "war", "book"))]
    return spark.createDataFrame([*pages, ("Page 0", RICH % "character"), ("Plain", "no box"), ("Gone", None)], "title string, wikitext string")


def test_facts_are_made_once_and_from_what_is_read(spark):
    few, all_ = parse_pages(rich(spark), generate.READ), parse_pages(rich(spark))
    graph = generate.generate_graph(few)
    text = plan(graph)
    assert text.count("MapInArrow") == 1 and "size(" not in text and "array_distinct" not in text
    assert "size(" not in plan(generate.type_triples(few))
    assert rows_of(graph) == rows_of(generate.generate_graph(all_)) and graph.count() == len(set(rows_of(graph))) > 60
    first = few.filter("title = 'Page 1'").first()
    assert set(first.plain) <= set(generate.READ["plain"]) and first.params["other"] == "[[Z]] {{TA|1}}" and first.links["location"] == ["L", "M"]
    sizes = {r.title: r.triples for r in generate.page_sizes(generate.page_facts(few.dropDuplicates(["title"]))).collect()}
    own = graph.filter("s LIKE '%/Page_2' OR s LIKE '%/O'")
    assert sizes["Page 2"] == own.count() and "Plain" not in sizes


def test_merge_of_graphs_shuffles_once(spark):
    before = small(spark)
    more = before.limit(5).unionByName(triples_of(spark, [("http://a/n", LABEL, "n", "literal", None, "en"), ("http://a/n", LABEL, "n", "literal", None, "en"), ("http://a/n", LABEL, "n", "literal")]))
    new = added(before, more)
    assert plan(new).count("Exchange hashpartitioning") == 1 and "Join" not in plan(new)
    assert rows_of(new) == rows_of(triples_of(spark, [("http://a/n", LABEL, "n", "literal", None, "en"), ("http://a/n", LABEL, "n", "literal")]))


def test_builds_parse_only_pages_that_categories_ask_for(spark, monkeypatch):
    parsed = []
    monkeypatch.setattr(queries, "parse_pages", lambda pages, *a: parsed.append(pages) or parse_pages(pages, *a))
    row = queries.QUERIES["e14_build_stats"](spark, "/root/testdata/sf0.001").first()
    asked = queries.picked(spark, "/root/testdata/sf0.001").select("title").distinct()
    assert len(parsed) == 2 and row.success > 0
    for pages in parsed:  # all that are asked for, and hardly any other of the wiki's pages
        assert asked.join(pages, "title", "left_anti").isEmpty() and pages.count() <= asked.count() + 1
