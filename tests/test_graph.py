import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kgspark.model import DOMAIN, LABEL, NS, RANGE, SAME_AS, SCHEMA, SUBCLASS, SUBPROPERTY, TRIPLE_COLUMNS, TYPE, merge, triples_of
from kgspark.operators import enrich, explore, infer, ontology, validate
from kgspark.sources import readers, writers

C, L = NS.ont + "Character", NS.ont + "Location"


def test_golden_counts(spark):
    assert ontology.ontology_triples(spark).dropDuplicates().count() == 65
    assert ontology.shape_triples(spark).dropDuplicates().count() == 24
    assert ontology.shape_table(spark).count() == 23 and ontology.shape_table(spark).select("target_class", "path").distinct().count() == 18
    assert ontology.shape_table(spark, extended=False).count() == 4


def test_closure_on_a_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a")]
    g = triples_of(spark, [(s, SUBCLASS, o, "iri") for s, o in edges])
    closure = infer.subclass_closure(g)
    assert closure.count() == 9
    chain = triples_of(spark, [(f"c{i}", SUBCLASS, f"c{i + 1}", "iri") for i in range(120)])
    assert infer.subclass_closure(chain).count() == 121 * 122 // 2
    types = spark.createDataFrame([("x", "d"), ("y", "a")], "entity string, type string")
    assert {(r.entity, r["class"]) for r in infer.with_ancestors(types, closure).collect()} == {("x", "d"), ("y", "a"), ("y", "b"), ("y", "c")}


def test_closure_of_a_chain_and_a_cycle_of_a_thousand(spark):
    rows = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(1000)] + [(f"o{i}", f"o{(i + 1) % 1000}") for i in range(1000)] + [("c0500", "o7")]
    closure = infer.subclass_closure(triples_of(spark, [(a, SUBCLASS, b, "iri") for a, b in rows]))
    assert closure.count() == 1001 * 1002 // 2 + 1000 * 1000 + 501 * 1000
    assert closure.distinct().count() == closure.count() and closure.filter("class = 'c0501' AND ancestor LIKE 'o%'").isEmpty()


def reachable(rows):
    nodes = {x for r in rows for x in r}
    out = {(n, n) for n in nodes} | set(rows)
    while True:
        more = {(a, d) for a, b in out for c, d in rows if b == c} - out
        if not more:
            return out
        out |= more


def test_closure_equals_brute_force(spark):
    rng = random.Random(12)
    for n in (4, 12, 30):
        rows = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(n + rng.randrange(n))}
        got = infer.subclass_closure(triples_of(spark, [(a, SUBCLASS, b, "iri") for a, b in rows])).collect()
        assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == reachable(rows)


def entail(rows):
    """All rules, one triple at a time, until nothing is new."""
    known = set(rows)
    while True:
        new = set()
        of = lambda p: {(s, o) for s, q, o, _ in known if q == p}
        for s, p, o, kind in known:
            new |= {(s, q, o, kind) for a, q in reachable(of(SUBPROPERTY)) if a == p}
            new |= {(s, TYPE, c, "iri") for a, c in of(DOMAIN) if a == p}
            new |= {(o, TYPE, c, "iri") for a, c in of(RANGE) if a == p and kind == "iri"}
            new |= {(s, TYPE, d, "iri") for c, d in reachable(of(SUBCLASS)) if p == TYPE and c == o}
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize("more", [[], [("a", SUBPROPERTY, TYPE, "iri")], [("b", SUBPROPERTY, SUBCLASS, "iri")], [(TYPE, DOMAIN, "Typed", "iri"), (TYPE, SUBPROPERTY, "kind", "iri"), ("b", SUBPROPERTY, SUBPROPERTY, "iri")]])
def test_materialize_is_a_fixpoint(spark, more):
    facts = [("x", "a", "C", "iri"), ("C", "b", "D", "iri"), ("D", SUBCLASS, "E", "iri"), ("y", TYPE, "C", "iri"), ("z", "c", "w", "iri"), ("z", "c", "text", "literal"), ("c", DOMAIN, "C", "iri"), ("d", RANGE, "F", "iri"), ("c", SUBPROPERTY, "d", "iri"), ("u", "C", "v", "iri"), ("F", SUBCLASS, "E", "iri")]
    rows = facts + more
    none = triples_of(spark, [])
    got = validate.rdfs_materialize(triples_of(spark, rows), none)
    assert {(r.s, r.p, r.o, r.o_kind) for r in got.collect()} == entail(rows) and got.count() == got.distinct().count()


def test_same_as_branches(spark):
    g = triples_of(spark, [("e", SAME_AS, "x", "iri"), ("x", "p", "o", "iri"), ("y", SAME_AS, "e", "iri"), ("y", "q", "z", "iri"), ("w", "r", "x", "iri")])
    seeds = spark.createDataFrame([("e",)], "entity string")
    found = {(r.subject, r.predicate, r.object, r.source) for r in infer.relations_with_sameas(g, seeds).collect()}
    assert found == {("e", SAME_AS, "x", "direct"), ("y", SAME_AS, "e", "direct"), ("x", "p", "o", "sameAs-outgoing"), ("y", "q", "z", "sameAs-incoming"), ("w", "r", "x", "sameAs-as-object")}


def test_validation(spark):
    bare = triples_of(spark, [("c", TYPE, C, "iri")])
    assert validate.missing_labels(bare).count() == 1 and validate.conforms(validate.violations(bare)).first().conforms is False
    odd = triples_of(spark, [("c", TYPE, C, "iri"), ("c", LABEL, "C", "literal", None, "en"), ("c", SCHEMA + "gender", "Other", "literal")])
    rows = validate.violations(odd)
    assert [r.severity for r in rows.collect()] == ["warning"] and validate.conforms(rows).first().conforms is True
    event = triples_of(spark, [("b", TYPE, NS.ont + "Battle", "iri"), ("b", TYPE, SCHEMA + "Event", "iri")])
    assert validate.violations(event).count() == 0 and validate.shacl_validate(event, ontology.shape_table(spark)).count() == 1


def test_entailment_then_shapes(spark):
    g = triples_of(spark, [("c", TYPE, C, "iri"), ("c", LABEL, "C", "literal", None, "en"), ("c", NS.prop + "realm", "Shire", "literal")])
    onto = ontology.ontology_triples(spark)
    wide = validate.rdfs_materialize(g, onto)
    assert wide.filter((F.col("s") == "c") & (F.col("p") == TYPE) & (F.col("o") == L)).count() == 1
    found = {(r.path, r.constraint) for r in validate.shacl_validate(wide, ontology.shape_table(spark)).collect()}
    assert (NS.prop + "realm", "nodeKind") in found


def people(spark, *names):
    return triples_of(spark, [x for n in names for x in ((NS.res + n.replace(" ", "_"), TYPE, C, "iri"), (NS.res + n.replace(" ", "_"), LABEL, n, "literal", None, "en"))])


def cards(spark, text):
    return readers.cards_from_json(spark.createDataFrame([(json.dumps(text),)], "value string"))


def test_cards(spark):
    deck = cards(spark, {"s1": {"cards": {"a": {"name": "Gandalf", "type": "old"}, "b": {"name": {"en": "Gandalf"}, "text": {"en": "<b>Wizard</b>"}, "attributes": {"prowess": 0, "body": "0"}}, "c": 5}}, "Frodo": {"name": "Frodo", "prowess": 5.7, "id": "F1"}, "x": 3})
    assert deck.count() == 3
    out = {(r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], r.o) for r in enrich.enrich_cards(people(spark, "Gandalf"), deck).collect()}
    assert ("description", "Wizard") in out and ("body", "0") in out and not any(p in ("prowess", "cardType") for p, _ in out)
    frodo = {(r.p.rsplit("/", 1)[-1], r.o) for r in enrich.enrich_cards(people(spark, "Frodo"), deck).collect()}
    assert ("prowess", "5") in frodo and ("card", NS.card + "F1") in frodo


def test_fuzzy_equals_brute_force(spark):
    names = ["gandalf", "gandolf", "galadriel", "galadriell", "thorin oakenshield", "thorin oakensheild", "frodo", "frodos", "bilbo baggins", ""]
    deck = spark.createDataFrame([(i, n) for i, n in enumerate(names[::-1])], "pos long, name_en string")
    for threshold in (0.85, 0.9):
        found = {r.name: r.pos for r in enrich.match_fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), deck, threshold).collect()}
        wanted = {}
        for n in names:
            scored = [(SequenceMatcher(None, n, c).ratio(), -i) for i, c in enumerate(names[::-1]) if c]
            best = max(scored) if n else (0, 0)
            if best[0] >= threshold:
                wanted[n] = -best[1]
        assert found == wanted


@pytest.mark.parametrize("threshold", [0.85, 0.9])
def test_fuzzy_on_names_of_one_template(spark, threshold):
    """All names share most of their grams; they differ in digits, a letter more, less or changed."""
    rng = random.Random(6)
    names = [f"Agent#{i:06d}" for i in rng.sample(range(3000), 60)] + [f"The agent of number {i:04d} in long" for i in range(20)] + ["x", "", "--"]
    change = [lambda x: x + "s", lambda x: x.replace("#", ""), lambda x: x.replace("A", "E"), lambda x: x[:5] + x[6:] + "ly", lambda x: x[::-1], lambda x: x[1:] + x[0]]
    cards = [(i, rng.choice(change)(x)) for i, x in enumerate(names + names[:20])]
    norm = lambda x: " ".join(x.lower().replace("'", "").replace("-", " ").split())
    first = {}
    for pos, x in cards:
        first.setdefault(norm(x), pos)
    want = {}
    for n in names:
        scores = [(SequenceMatcher(None, norm(n), x).ratio(), -pos) for x, pos in first.items() if x] if norm(n) else []
        if scores and max(scores)[0] >= threshold:
            want[n] = (-max(scores)[1], round(max(scores)[0], 9))
    got = enrich.match_fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(cards, "pos int, name_en string"), threshold).collect()
    assert {r.name: (r.pos, round(r.score, 9)) for r in got} == want


def test_fuzzy_equals_brute_force_at_random(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc01") for _ in range(rng.randrange(1, 24))) for _ in range(60)] + ["template 0000" + str(i) for i in range(0, 400, 7)]
    deck = [n for n in names[::3]]
    for n in names[::2]:
        n = list(n)
        for _ in range(rng.randrange(0, 3)):
            n.insert(rng.randrange(len(n) + 1), rng.choice("abc01"))
        if rng.random() < 0.5:
            n.pop(rng.randrange(len(n)))
        deck.append("".join(n))
    cards = spark.createDataFrame(list(enumerate(deck)), "pos long, name_en string")
    for threshold in (0.7, 0.9):
        found = {r.name: (r.pos, round(r.score, 9)) for r in enrich.match_fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), cards, threshold).collect()}
        wanted = {}
        for n in names:
            score, pos = max((SequenceMatcher(None, n, c).ratio(), -i) for i, c in enumerate(deck) if c)
            if score >= threshold:
                wanted[n] = (-pos, round(score, 9))
        assert found == wanted


def test_csv_and_languages(spark):
    g = merge(people(spark, "Frodo Baggins"), triples_of(spark, [(NS.res + "Frodo_Baggins", SCHEMA + "gender", "male", "literal"), (NS.res + "Frodo_Baggins", NS.prop + "raceLabel", "Hobbit", "literal")]))
    sheet = spark.createDataFrame([(0, "Frodo Baggins", "Male", "Hobbit", "Brown", "1.06m", "The Shire")], "pos long, name string, gender string, race string, hair string, height string, realm string")
    assert enrich.enrich_csv(g, sheet).count() == 3
    titles = spark.createDataFrame([("Frodo Baggins", "fr", 1, "Frodon Sacquet"), ("Frodo Baggins", "de", 1, "Frodo Baggins")], "query string, lang string, rank int, title string")
    assert enrich.enrich_multilingual(g, titles).count() == 2
    assert tuple(enrich.multilingual_stats(g, titles).first()) == (1, 1, 1)


def test_a_hub_is_written_in_blocks(spark):
    g = spark.range(1_000_000).select(F.lit("http://a/hub").alias("s"), F.lit(SCHEMA + "owns").alias("p"), F.concat(F.lit("http://a/"), "id").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    made = writers.to_turtle(g.unionByName(triples_of(spark, [("http://a/x", "http://a/p", "1", "literal"), ("http://a/x", TYPE, "http://a/C", "iri")])))
    rows = made.select("s", F.length("block").alias("n"), F.size(F.split("block", "\n")).alias("lines")).collect()
    assert sum(r.lines for r in rows if r.s == "http://a/hub") == 1_000_000 and max(r.n for r in rows) < 1_100_000 and max(r.lines for r in rows) <= 10_000
    assert made.filter("s = 'http://a/x'").first().block == '<http://a/x> <http://a/p> "1" ;\n    a <http://a/C> .'
    nodes = [json.loads(r.node) for r in writers.to_jsonld(g.limit(25), most_lines=10).collect()]
    assert len(nodes) >= 3 and sum(len(n[SCHEMA + "owns"]) for n in nodes) == 25 and {n["@id"] for n in nodes} == {"http://a/hub"}


def test_round_trips(spark, tmp_path):
    g = triples_of(spark, [("http://a/s", "http://a/p", 'say "hi"\\n\n\tx', "literal", None, "en"), ("http://a/s", "http://a/p", "5", "literal", "http://a/int"), ("http://a/s", TYPE, "http://a/C", "iri"), ("http://a/t", "http://a/q", "<&>", "literal")])
    writers.export_graph(g, str(tmp_path / "nt"), "nt")
    assert set(readers.read_ntriples(spark, str(tmp_path / "nt")).collect()) == set(g.collect())
    writers.write_ontology(spark, str(tmp_path / "ontology"), "nt")
    writers.write_shapes(spark, str(tmp_path / "shapes"), "nt")
    assert readers.read_ntriples(spark, str(tmp_path / "ontology")).count() == 65 and readers.read_ntriples(spark, str(tmp_path / "shapes")).count() == 24
    for fmt in ("turtle", "jsonld", "xml"):
        writers.export_graph(g.coalesce(1), str(tmp_path / fmt), fmt)
    for node in spark.read.text(str(tmp_path / "jsonld")).collect():
        assert json.loads(node.value)["@id"].startswith("http://a/")
    import xml.etree.ElementTree as ET

    for part in (tmp_path / "xml").glob("part-*"):
        ET.parse(part)
    with pytest.raises(ValueError):
        writers.export_graph(g, str(tmp_path / "no"), "no")


def test_readers(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<w><page><title>A</title><revision><text>t &lt;b&gt;</text></revision></page><page><title>B</title></page></w>")
    assert {tuple(r) for r in readers.read_pages(spark, str(tmp_path / "d.xml"), "xml").collect()} == {("A", "t <b>"), ("B", None)}
    (tmp_path / "c.csv").write_text("name,gender,race,hair,height,realm\nFrodo,Male,,,,\n,Male,,,,\n")
    assert [r.name for r in readers.read_character_csv(spark, str(tmp_path / "c.csv")).collect()] == ["Frodo"]
    (tmp_path / "cards.json").write_text(json.dumps({"s": {"cards": {"a": {"name": "X"}}}}))
    kept = str(tmp_path / "kept")
    assert readers.cached_cards(spark, str(tmp_path / "cards.json"), kept).count() == 1 == readers.cached_cards(spark, "nowhere", kept).count()


def test_facets_pick_is_bounded(spark):
    g = people(spark, *[f"P {i}" for i in range(70)])
    assert explore.facet_entities(g, [C], []).count() == 50 and explore.facet_entities(g, [C], [], pick=12).count() == 12
