import pytest
from pyspark.sql import functions as F

from kgspark.functions.wikitext import clean_date, clean_wikitext, internal_links, parse_pages
from kgspark.model import LABEL, NS, SCHEMA
from kgspark.operators import generate

FRODO = """{{Infobox character
| name = '''Frodo Baggins'''
| othernames = Mr. Underhill<br/>See below
| gender = Male
| race = [[Hobbits|Hobbit]]
| birth = {{TA|2968}}
| birthlocation = [[The Shire]], [[Hobbiton]]
| death = Unknown
| children = [[None]]
| siblings =
}}"""


def test_frodo(spark):
    page = parse_pages(spark.createDataFrame([("Frodo Baggins", FRODO)], "title string, wikitext string"))
    row = page.first()
    assert row.itype == "character" and row.status == "success" and len(row.params) == 8
    facts = {(r.s.rsplit("/", 1)[1], r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], r.o) for r in generate.body_triples(page, generate.character_facts(), None).collect()}
    assert facts == {
        ("Frodo_Baggins", "name", "Frodo Baggins"), ("Frodo_Baggins", "alternateName", "Mr. Underhill"), ("Frodo_Baggins", "gender", "male"), ("Frodo_Baggins", "race", NS.res + "Hobbits"),
        ("Frodo_Baggins", "raceLabel", "Hobbit"), ("Frodo_Baggins", "birthDate", "TA 2968"), ("Frodo_Baggins", "birthPlace", NS.res + "The_Shire"),
    }
    assert generate.generate_graph(page).count() == 15


def test_owners_and_statuses(spark):
    pages = spark.createDataFrame([("Ring", "{{Infobox weapon|owner=[[Bilbo]], [[Frodo]]}}"), ("Gone", None), ("Plain", "no box"), ("Quote", "{{quote|a battle}}")], "title string, wikitext string")
    page = parse_pages(pages)
    assert {r.title: r.status for r in page.collect()} == {"Ring": "success", "Gone": "no_page", "Plain": "no_infobox", "Quote": "no_infobox"}
    graph = generate.generate_graph(page)
    assert graph.filter(F.col("p") == SCHEMA + "owns").count() == 2 and graph.filter(F.col("p") == NS.prop + "ownedBy").count() == 2


def test_first_infobox_and_nesting(spark):
    text = "<!-- {{Infobox album}} --> {{Sidebar|x={{Infobox book|name=B|note={{small|[[A|b|c]]}} = d}}}} {{Battle}}"
    row = parse_pages(spark.createDataFrame([("T", text)], "title string, wikitext string")).first()
    assert (row.template, row.itype) == ("infobox book", "book") and row.params == {"name": "B", "note": "{{small|[[A|b|c]]}} = d"}


@pytest.mark.parametrize(("given", "wanted"), [("{{TA|2931}}", "TA 2931"), ("{{FA|532}} – {{FA|600}}", "FA 532"), ("{{ta|2931}}", ""), ("[[March 1]], [[Third Age 2931|2931]]", "March 1, 2931"), ("{{TA|1<ref>x</ref>[2]}}", "TA 1")])
def test_clean_date(given, wanted):
    assert clean_date(given) == wanted


def test_text_and_links():
    assert clean_wikitext("\"'''Bold''' [[A|b]] [1] <i>x</i> {{t|u}}  &amp; [http://u v]\"") == "Bold b x & v"
    assert internal_links("[[Elves|elf]] [[File:x.png|thumb|[[Men]]]] [[Men#North]] [[ Hobbits ]]") == ["Elves", "Men", "Hobbits"]
    assert clean_wikitext(None) == "" and internal_links(None) == []


def test_duplicates(spark):
    titles = spark.createDataFrame([(1, "c1", 0, "A"), (1, "c1", 1, "B"), (1, "c1", 2, "C"), (2, "c2", 0, "B"), (2, "c2", 1, "C"), (2, "c2", 2, "D")], "cat_idx int, category string, pos int, title string")
    status = spark.createDataFrame([("A", "success"), ("B", "no_page"), ("C", "success"), ("D", "no_infobox")], "title string, status string")
    done = generate.dedupe_pages(titles, status)
    sizes = spark.createDataFrame([("A", 6), ("C", 7)], "title string, triples long")
    row = generate.build_stats(done, sizes).first()
    assert (row.processed, row.success, row.no_infobox, row.errors, row.triples, row.duplicates_skipped) == (5, 2, 1, 2, 13, 1)
    assert LABEL
