"""Sides of joins that grow with the data must not pass through the driver, however small Spark guesses them."""

from kgspark.functions.wikitext import parse_pages
from kgspark.model import SAME_AS, SCHEMA
from kgspark.operators import enrich, generate, linking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def linked(spark):
    names = spark.createDataFrame([("Frodo",), ("Sam",), ("Bree",)], "name string")
    hits = spark.createDataFrame([("Frodo", 1, "Frodo"), ("Sam Tolkien", 2, "Sam (character)")], "query string, rank int, title string")
    props = spark.createDataFrame([("Frodo", "Q1")], "title string, wikibase_item string")
    items = spark.createDataFrame([("Bree", 1, "Q2", "a fictional village")], "query string, rank int, id string, description string")
    return names, linking.discover_links(names, hits, props, items)


def test_linking_broadcasts_nothing(spark):
    names, links = linked(spark)
    known = links.filter("link_type = 'dbpedia'").select("uri")
    for df in (links, linking.linking_summary(names, links), linking.verify_links(links, known)):
        assert "Broadcast" not in plan(df)
    assert {(r.name, r.link_type) for r in links.collect()} == {("Frodo", "wikipedia"), ("Frodo", "dbpedia"), ("Frodo", "yago"), ("Frodo", "wikidata"), ("Sam", "wikipedia"), ("Sam", "dbpedia"), ("Sam", "yago"), ("Bree", "wikidata")}
    assert linking.linking_summary(names, links).first().asDict() == {"total": 3, "found": 3}


def test_fuzzy_names_broadcast_no_strings(spark):
    names = spark.createDataFrame([("gandalf",), ("frodo baggins",)], "name string")
    cards = spark.createDataFrame([(1, "gandalff"), (2, "frodo bagins")], "pos int, name_en string")
    found = enrich.match_fuzzy(names, cards, 0.9)
    assert not [x for x in plan(found).splitlines() if "BroadcastHashJoin" in x and ("key#" in x or "gram#" in x or "name#" in x)]
    assert {(r.name, r.pos) for r in found.collect()} == {("gandalf", 1), ("frodo baggins", 2)}


def test_generation_broadcasts_no_images_or_links(spark):
    box = "{{Infobox character|name=%s|image=%s}}"
    wiki = spark.createDataFrame([("Frodo", box % ("Frodo", "File:F.jpg")), ("Sam", "{{Infobox character|name=Sam}}")], "title string, wikitext string")
    images = spark.createDataFrame([("F.jpg", "https://img/1")], "filename string, url string")
    links = spark.createDataFrame([("Sam", "dbpedia", "http://d/Sam")], "name string, link_type string, uri string")
    made = generate.generate_graph(parse_pages(wiki, ("plain", "links", "dates")), links, images)
    assert "BroadcastHashJoin" not in plan(made)
    got = {(r.p, r.o) for r in made.collect()}
    assert (SCHEMA + "image", "https://img/1") in got and (SAME_AS, "http://d/Sam") in got and sum(p == SCHEMA + "image" for p, _ in got) == 1
