import pytest
from pyspark.sql import functions as F

from kgspark.functions import scalars as S
from kgspark.operators.enrich import similarity


def run(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("Frodo Baggins", "Frodo_Baggins"), ("Bard (King of Dale)", "Bard_King_of_Dale"), ("Durin's Bane", "Durins_Bane"), ("Durin’s Bane", "Durins_Bane"), ("Éowyn", "Éowyn"), ("Ar-Pharazôn", "Ar-Pharazôn"), ("Minas Tirith/Gallery", "Minas_TirithGallery"), ("", "")])
def test_clean_entity_name(spark, given, wanted):
    assert run(spark, S.clean_entity_name, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [(" Ar-Pharazôn ", "ar pharazôn"), ("Durin's Bane", "durins bane"), ("Durin’s Bane", "durin’s bane"), (None, "")])
def test_normalize_name(spark, given, wanted):
    assert run(spark, S.normalize_name, given) == wanted


@pytest.mark.parametrize(("a", "b", "ratio"), [("gandalf", "gandolf", 0.8571), ("galadriel", "galadriell", 0.9474), ("ar pharazôn", "ar pharazon", 0.9091), ("thorin oakenshield", "thorin oakensheild", 0.9444), ("frodo baggins", "bilbo baggins", 0.6923)])
def test_similarity(spark, a, b, ratio):
    assert run(spark, similarity, a, b) == pytest.approx(ratio, abs=5e-5)


@pytest.mark.parametrize(("given", "wanted"), [("Infobox character", "character"), ("Infobox bookcharacter", "character"), ("Infobox place", "place"), ("Infobox location", "location"), ("campaign", "war"), ("battle", "battle"), ("Infobox campaign", "unknown"), ("Infobox conflict", "war"), ("Infobox dwarf", "war"), ("Infobox album", "unknown")])
def test_detect_type(spark, given, wanted):
    assert run(spark, S.detect_type, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [(x, False) for x in ("", ", .", "c.", "around", "Unknown", "Late Third Age", "early in the First Age")] + [("TA 3019", True), ("around TA 10", True)])
def test_is_valid_date(spark, given, wanted):
    assert run(spark, S.is_valid_date, given) is wanted


@pytest.mark.parametrize(
    ("given", "safe", "wanted"),
    [("Rings_of_Power_(Tolkien)", "_(),-", "Rings_of_Power_(Tolkien)"), ("Rings_of_Power_(Tolkien)", "/", "Rings_of_Power_%28Tolkien%29"), ("Éowyn,_a/b~c*d!", "_(),-", "%C3%89owyn,_a%2Fb~c%2Ad%21"), ("Éowyn,_a/b~c*d!", "_-", "%C3%89owyn%2C_a%2Fb~c%2Ad%21"), ("Éowyn,_a/b~c*d!", "/", "%C3%89owyn%2C_a/b~c%2Ad%21")],
)
def test_percent_encode(spark, given, safe, wanted):
    assert run(spark, lambda c: S.percent_encode(c, safe), given) == wanted


@pytest.mark.parametrize(("title", "name", "wanted"), [("Gandalf", "Gandalf", True), ("Moria, Middle-earth", "Moria", True), ("Elrond (disambiguation)", "Elrond", True), ("Frodo Baggins", "Frodo", False), ("Minas Morgul", "Minas Tirith", False), ("The Hobbit (film)", "Bilbo", False), ("Gandalf", " ", False)])
def test_is_domain_title(spark, title, name, wanted):
    assert run(spark, S.is_domain_title, title, name) is wanted


def test_others(spark):
    assert run(spark, S.split_on_br, "A<br>B<BR />C<br/><br>") == ["A", "B", "C"]
    assert run(spark, S.internal_links, "[[Elves|elf]] and [[File:x.png]] [[Men#North]] [[Category:Y]] [[ Hobbits ]] [[Elves]]") == ["Elves", "Hobbits", "Elves"]
    assert run(spark, S.image_hash_url, "File:My Picture (1).jpg").endswith("/images/d/d3/My%20Picture%20%281%29.jpg")
    assert run(spark, S.image_page_url, "") is None
    assert [run(spark, S.local_name, x) for x in ("http://a/b#C", "http://a/b/C")] == ["C", "C"]
    assert run(spark, S.trim_ws, "\n\t a b \u00a0") == "a b"
    assert [run(spark, S.language_name, x) for x in ("fr", "xx")] == ["French", "XX"]
