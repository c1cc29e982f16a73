"""Card files cut into cards, against a parser that reads them whole."""

import json
import random

import pytest

from kgspark.sources import readers
from kgspark.sources.jsonsplit import split_cards


def by_hand(text):
    """The cards of a file in its order."""
    out = []
    for entry in json.loads(text).values():
        if isinstance(entry, dict):
            cards = entry["cards"].values() if isinstance(entry.get("cards"), dict) else [entry]
            out += [c for c in cards if isinstance(c, dict)]
    return out


def some_string(rng):
    return "".join(rng.choice(["a", "é", "}", "{", '"', "\\", "cards", ":", ",", "[", "]", " ", "\n", " "]) for _ in range(rng.choice([0, 1, 3, 30])))


def some_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return some_string(rng)
    if kind < 4:
        return rng.choice([None, True, -1.5e3, 7])
    if kind == 4:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice([some_string(rng), "cards", "name"]): some_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def some_file(rng):
    file = {}
    for i in range(rng.randrange(1, 12)):
        body = {f"k{j}": some_value(rng) for j in range(rng.randrange(3))}
        if rng.random() < 0.5:
            body["cards"] = {f"c{j}{some_string(rng)}": some_value(rng) for j in range(rng.randrange(8))}
            body |= {"after": some_value(rng)} if rng.random() < 0.5 else {}
        file[f"{i}{some_string(rng)}"] = body if rng.random() < 0.8 else some_value(rng)
    return json.dumps(file, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split", [37, 400, 1 << 20])
def test_cards_equal_those_of_a_whole_parse(spark, tmp_path, split):
    rng = random.Random(split)
    texts = [some_file(rng) for _ in range(12)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i:02}.json").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = [json.loads(r.card) for r in split_cards(spark, str(tmp_path)).orderBy("pos").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [card for text in texts for card in by_hand(text)]


def test_sets_without_cards_and_empty_files(spark, tmp_path):
    for name, text in {"a": "", "b": "{}", "c": '{"s": {"cards": {}}, "x": 3, "l": [{"cards": {"k": {}}}]}\n', "d": '{"Frodo": {"name": "Frodo", "card\\u0073": {"q": {"name": "Sam"}}}}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert [r.name_en for r in readers.read_cards(spark, str(tmp_path)).collect()] == ["Sam"]


def test_fields_are_those_of_a_text_read_whole(spark, tmp_path):
    deck = {"s1": {"cards": {"a": {"name": {"en": "Gandalf"}, "attributes": {"prowess": 6.0, "body": "0", "race": "Wizard"}}, "b": {"Name": "Pippin", "type": "hero"}}}, "Frodo": {"name": "Frodo", "id": "F1"}}
    (tmp_path / "cards.json").write_text(json.dumps(deck))
    whole = readers.cards_from_json(spark.createDataFrame([(json.dumps(deck),)], "value string"))
    assert sorted(map(str, readers.read_cards(spark, str(tmp_path)).drop("pos").collect())) == sorted(map(str, whole.drop("pos").collect()))
