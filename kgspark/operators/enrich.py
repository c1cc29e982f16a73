"""Enrichment of entities from cards, character tables and titles in other languages."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.scalars import normalize_name, strip_html, underscored
from kgspark.model import INTEGER, LABEL, NS, SCHEMA, SEE_ALSO, TRIPLE_COLUMNS, TYPE, Namespaces, checkpointed, fact, facts_to_triples, first_label, instances, iri, large, likely, match


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two normalised names; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a, b):
    """The ratio of two names as columns."""
    return name_ratio(normalize_name(a), normalize_name(b))


def last_by_name(df: DataFrame, name: str, pos: str) -> DataFrame:
    """One row per normalised, non-empty name: the last by position; adds ``norm``."""
    rows = df.withColumn("norm", normalize_name(F.col(name))).filter("norm <> ''")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("norm").orderBy(F.desc(pos)))).filter("n = 1").drop("n")


def match_cards_exact(names: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, card columns) where normalised names are equal; of cards of one name the last wins."""
    return names.withColumn("norm", normalize_name(F.col("name"))).join(last_by_name(cards, "name_en", "pos"), "norm")


def _histogram(c: Column) -> Column:
    """Counts of letters and digits of a name, in an order that both sides share: a cheap bound of the ratio."""
    return F.array(*[F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in "aeioustnrlhd0123456789"])


def _grams(names: DataFrame, name: str, q: int) -> DataFrame:
    """(name, gram): the strings of ``q`` letters of each name, numbered where they repeat, so they are distinct."""
    length = F.length(name)
    plain = F.when(length >= q, F.transform(F.sequence(F.lit(1), length - q + 1), lambda i: F.substring(F.col(name), i, F.lit(q))))
    counted = names.select(name, F.explode(plain).alias("gram")).groupBy(name, "gram").count()
    return counted.select(name, "gram", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("i")).select(name, F.concat("gram", F.lit(":"), F.col("i").cast("string")).alias("gram"))


def _rarest_first(names: DataFrame, name: str, grams: DataFrame, often: DataFrame) -> DataFrame:
    """``names`` with their grams in order of their number over both sides."""
    ranked = grams.join(large(often), "gram").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("often", "gram")))["gram"].alias("ranked"))
    return names.join(large(ranked), name, "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))


def _shorter(c: Column, most: int) -> Column:
    """Strings left by deleting as many letters as the column ``gone`` says, ``most`` at most, as an array without repeats."""
    each = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    levels = [F.array(c)]
    for _ in range(most):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], each))))
    out = levels[0]
    for n, level in enumerate(levels[1:], 1):
        out = F.when(F.col("gone") == n, level).otherwise(out)
    return out


def _choose(n: str, k: Column, most: int) -> Column:
    """Binomial coefficient of a length for k up to ``most``; beyond, a number that no bound admits."""
    out = F.lit(1 << 40).cast("long")
    for j in range(most, -1, -1):
        product = F.lit(1).cast("long")
        for i in range(j):
            product = product * (F.col(n) - i) / (i + 1)
        out = F.when(k == j, product.cast("long")).otherwise(out)
    return out


#: Names are met by deletions only where at most so many letters go and so many strings are left on either side.
MOST_GONE, MOST_STRINGS = 3, 6_000


def _fuzzy_pairs(own: DataFrame, other: DataFrame, threshold: float, q: int) -> DataFrame:
    """(name, a, b, pos) of all names that may reach the threshold, and of few that don't; see ``match_fuzzy``."""
    factor = threshold / (2 - threshold)
    reach = lambda n: F.explode(F.sequence(F.ceil(F.col(n) * factor - 1e-9).cast("int"), F.floor(F.col(n) / factor + 1e-9).cast("int")))
    common = F.ceil(threshold * (F.col("na") + F.col("nb")) / 2 - 1e-9).cast("int")
    gone_a, gone_b = F.col("na") - common, F.col("nb") - common
    few = (F.greatest(gone_a, gone_b) <= MOST_GONE) & (F.greatest(_choose("na", gone_a, MOST_GONE), _choose("nb", gone_b, MOST_GONE)) <= MOST_STRINGS)
    possible = common <= F.least("na", "nb")
    # One row per name and length on the other side; the lengths there are no more than the longest name has letters.
    own = own.withColumn("nb", reach("na")).filter(possible).join(other.select("nb").distinct(), "nb", "left_semi").withColumn("few", few)
    other = other.withColumn("na", reach("nb")).filter(possible).join(own.select("na").distinct(), "na", "left_semi").withColumn("few", few)

    deleted = lambda side, c, gone: side.filter("few").withColumn("gone", gone).withColumn("key", F.explode(F.transform(_shorter(F.col(c), MOST_GONE), lambda x: F.xxhash64(x))))
    keyed = deleted(other, "b", gone_b).select("b", "pos", "hb", "na", "nb", "key")
    # Long names leave hundreds of strings each, of which few are met. So they go before the shuffle, by filters of each pair of lengths.
    bits = 1 << max(6, 26 - other.filter("few").select("na", "nb").distinct().count().bit_length())
    near = likely(deleted(own, "a", gone_a).select("name", "a", "ha", "na", "nb", "key"), "key", keyed, "key", bits, ("na", "nb")).join(large(keyed), ["na", "nb", "key"])

    own, other = own.filter("NOT few"), other.filter("NOT few")
    own_grams, other_grams = _grams(own.select("a").distinct(), "a", q), _grams(other.select("b").distinct(), "b", q)
    often = own_grams.select("gram").unionByName(other_grams.select("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    left = lambda x, y: F.col(x) - q + 1 - q * (F.col(x) - common) - (q - 1) * (F.col(y) - common)
    shared = F.greatest(left("na", "nb"), left("nb", "na"))
    keys = F.explode(F.when(shared > 0, F.slice("ranked", F.lit(1), F.greatest(F.size("ranked") - shared + 1, F.lit(0)))).otherwise(F.array(F.lit("")))).alias("key")
    far = (
        _rarest_first(own, "a", own_grams, often).select("name", "a", "ha", "na", "nb", keys)
        .join(large(_rarest_first(other, "b", other_grams, often).select("b", "pos", "hb", "na", "nb", keys)), ["na", "nb", "key"])
    )
    differ = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    most = (1 - threshold) * (F.col("na") + F.col("nb")) + 1e-9
    return near.drop("key").unionByName(far.drop("key")).filter(differ <= most).select("name", "a", "b", "pos").repartition(_tasks(own), "name", "b").distinct()


def _tasks(df: DataFrame) -> int:
    """Partitions for rows that are few bytes but much work each, which Spark would join into few tasks by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def match_fuzzy(names: DataFrame, cards: DataFrame, threshold: float = 0.85, q: int = 3) -> DataFrame:
    """(name, pos, score): per name the card of highest ratio of at least the threshold, the first card on a tie.

    A ratio of t needs at least t/2 of all letters in common, in order, so the two lengths bound
    the letters that match nothing. Where these are few, names and cards meet by the strings that
    are left when so many letters are deleted: exactly the pairs with enough in common meet, even
    if all names follow one template. Where they are many, each of them breaks at most ``q`` grams of
    its own name and ``q`` - 1 of the other, and the rest are shared: of two names that share so
    many grams the rarest few of either hold a common one, and these are what they meet by,
    together with both lengths. Names too short for a sure gram meet by length alone. Pairs whose
    letter counts rule the ratio out are dropped before Python sees them.

    Half-way between the threshold and 1 comes first; a name that reaches it has seen all that are
    as near, so only the others go on. All of this is exact, not approximate.
    """
    own = names.select("name", normalize_name(F.col("name")).alias("a")).filter("a <> ''").distinct()
    own = own.select("name", "a", F.length("a").alias("na"), _histogram(F.col("a")).alias("ha")).repartition(_tasks(names), "name")
    other = cards.select("pos", normalize_name(F.col("name_en")).alias("b")).filter("b <> ''").groupBy("b").agg(F.min("pos").alias("pos"))
    other = other.select("b", "pos", F.length("b").alias("nb"), _histogram(F.col("b")).alias("hb")).repartition(_tasks(names), "b")
    best = None
    for level in ((1 + threshold) / 2, threshold):
        left = own if best is None else own.join(large(best.select("name")), "name", "left_anti")
        scored = _fuzzy_pairs(left, other, level, q).withColumn("score", name_ratio("a", "b")).filter(F.col("score") >= level)
        top = scored.groupBy("name").agg(F.max(F.struct("score", (-F.col("pos")).alias("at"))).alias("m")).select("name", (-F.col("m.at")).alias("pos"), F.col("m.score").alias("score"))
        best = checkpointed(top) if best is None else best.unionByName(top)
    return best


def labelled_characters(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """(s, name): characters with one label each."""
    who = instances(graph, ns.ont + "Character")
    labels = likely(match(graph, p=LABEL), "s", who, "s")
    return who.join(first_label(labels).withColumnRenamed("label", "name"), "s").filter("name <> ''")


def matched_cards(graph: DataFrame, cards: DataFrame, threshold: float = 0.9, ns: Namespaces = NS) -> DataFrame:
    """(s, name, card columns): by equal name, else by ratio; only names left over are compared."""
    who = checkpointed(labelled_characters(graph, ns))  # names are read some ten times, labels once
    names = who.select("name").distinct()
    exact = match_cards_exact(names, cards)
    left = checkpointed(names.join(exact.select("name"), "name", "left_anti"))
    fuzzy = match_fuzzy(left, cards, threshold).select("name", "pos").join(cards.withColumn("norm", normalize_name(F.col("name_en"))), "pos")
    return who.join(exact.unionByName(fuzzy), "name")


def enrich_cards(graph: DataFrame, cards: DataFrame, threshold: float = 0.9, ns: Namespaces = NS) -> DataFrame:
    """The triples of matched cards: the link, and the card's type, label, kind, text, numbers and set."""
    rows = matched_cards(graph, cards, threshold, ns)
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    number = lambda c: F.col(c).try_cast("int").cast("string")
    rows = rows.withColumn("card", F.concat(F.lit(ns.card), F.coalesce(some("card_id"), underscored(F.col("norm")))))
    links = facts_to_triples(rows, "s", F.array(iri(ns.prop + "card", F.col("card"))))
    about = F.array(
        iri(TYPE, F.lit(ns.ont + "Card")),
        fact(LABEL, some("name_en"), lang="en"),
        fact(ns.prop + "cardType", some("card_type")),
        fact(SCHEMA + "description", F.when(F.col("text_en") != "", strip_html(F.col("text_en"))), lang="en"),
        fact(ns.prop + "prowess", number("prowess"), dt=INTEGER),
        fact(ns.prop + "body", number("body"), dt=INTEGER),
        fact(ns.prop + "cardSet", some("card_set")),
    )
    return links.unionByName(facts_to_triples(rows, "card", about)).select(*TRIPLE_COLUMNS).dropDuplicates()


def card_stats(graph: DataFrame, cards: DataFrame, threshold: float = 0.9, ns: Namespaces = NS) -> DataFrame:
    """One row: characters checked, linked, and five triples for each as an estimate."""
    linked = matched_cards(graph, cards, threshold, ns).select("s").distinct().withColumn("hit", F.lit(1))
    return instances(graph, ns.ont + "Character").join(linked, "s", "left").agg(F.count("*").alias("checked"), F.count("hit").alias("linked"), (F.count("hit") * 5).alias("triples"))


def _csv_rows(graph: DataFrame, table: DataFrame, ns: Namespaces) -> DataFrame:
    who = labelled_characters(graph, ns).withColumn("norm", normalize_name(F.col("name")))
    return who.join(last_by_name(table, "name", "pos").drop("name", "pos"), "norm")


def enrich_csv(graph: DataFrame, table: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """The triples that a character table adds: gender and race only where absent, hair, height and realm always.

    ``table`` has name, gender, race, hair, height, realm and pos; of rows of one name the last wins.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    facts = F.array(
        fact(SCHEMA + "gender", F.lower(some("gender"))), fact(ns.prop + "raceLabel", some("race")), fact(ns.prop + "hairColor", some("hair")),
        fact(ns.prop + "height", some("height")), fact(ns.prop + "realm", some("realm")),
    )
    offered = facts_to_triples(_csv_rows(graph, table, ns), "s", facts)
    guarded = F.col("p").isin(SCHEMA + "gender", ns.prop + "raceLabel")
    present = graph.filter(guarded).select("s", "p").distinct()
    return offered.filter(~guarded).unionByName(offered.filter(guarded).join(present, ["s", "p"], "left_anti").select(*offered.columns)).select(*TRIPLE_COLUMNS)


def csv_stats(graph: DataFrame, table: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """One row: characters checked, matched, and triples offered."""
    matched = _csv_rows(graph, table, ns).select("s").distinct().withColumn("hit", F.lit(1))
    counts = instances(graph, ns.ont + "Character").join(matched, "s", "left").agg(F.count("*").alias("checked"), F.count("hit").alias("enriched"), F.lit(1).alias("one"))
    return counts.join(enrich_csv(graph, table, ns).agg(F.count("*").alias("triples"), F.lit(1).alias("one")), "one").drop("one")


def top1_title(titles: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(query, lang, title): the first hit of each query in the known languages."""
    return titles.filter(F.col("lang").isin(*languages)).groupBy("query", "lang").agg(F.min(F.struct("rank", "title"))["title"].alias("title"))


def translated_titles(graph: DataFrame, titles: DataFrame, languages: tuple[str, ...] = ("fr", "de", "es"), max_entities: int | None = None, ns: Namespaces = NS) -> DataFrame:
    """(s, name, lang, title, added): the entities looked at (all, or the first ``max_entities``), in each language that they lack a label in."""
    order = F.when(F.col("o") == ns.ont + "Character", 0).when(F.col("o") == ns.ont + "Location", 1).when(F.col("o") == ns.ont + "Artifact", 2)
    typed = graph.filter(F.col("p") == TYPE).select("s", order.alias("kind")).filter("kind IS NOT NULL").distinct()
    plain = graph.filter((F.col("p") == LABEL) & F.coalesce(F.col("o_lang") == "en", F.lit(True))).groupBy("s").agg(F.min("o").alias("name"))
    picked = typed.join(plain, "s")
    picked = picked if max_entities is None else picked.orderBy("kind", "s").limit(max_entities)
    wanted = picked.select("s", "name", F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang"))
    have = graph.filter((F.col("p") == LABEL) & F.col("o_lang").isin(*languages)).select("s", F.col("o_lang").alias("lang")).distinct()
    found = wanted.join(have, ["s", "lang"], "left_anti").join(top1_title(titles, languages).withColumnRenamed("query", "name"), ["name", "lang"], "left")
    return found.select("s", "name", "lang", "title", F.coalesce(F.col("title") != F.col("name"), F.lit(False)).alias("added"))


def enrich_multilingual(graph: DataFrame, titles: DataFrame, languages: tuple[str, ...] = ("fr", "de", "es"), max_entities: int | None = None, ns: Namespaces = NS) -> DataFrame:
    """Labels in other languages, with the pages that they come from."""
    rows = translated_titles(graph, titles, languages, max_entities, ns).filter("added")
    page = F.concat(F.lit(ns.foreign_wiki), F.col("lang"), F.lit("/wiki/"), underscored(F.col("title")))
    return facts_to_triples(rows, "s", F.array(fact(LABEL, F.col("title"), lang=F.col("lang")), iri(SEE_ALSO, page))).select(*TRIPLE_COLUMNS).distinct()


def multilingual_stats(graph: DataFrame, titles: DataFrame, languages: tuple[str, ...] = ("fr", "de", "es"), max_entities: int | None = None, ns: Namespaces = NS) -> DataFrame:
    """One row: entities checked, labels added, entities enriched."""
    rows = translated_titles(graph, titles, languages, max_entities, ns)
    return rows.agg(F.count_distinct("s").alias("checked"), F.count_if("added").alias("labels_added"), F.count_distinct(F.when(F.col("added"), F.col("s"))).alias("entities_enriched"))


def enrich_all(graph: DataFrame, cards: DataFrame | None = None, table: DataFrame | None = None, titles: DataFrame | None = None, max_entities: int | None = None, ns: Namespaces = NS) -> DataFrame:
    """The graph after cards, then the character table, then titles in other languages; each is optional.

    What a step adds is materialised once, since the next steps read the graph several times.
    """
    for more, f in ((cards, enrich_cards), (table, enrich_csv)):
        if more is not None:
            graph = graph.select(*TRIPLE_COLUMNS).unionByName(checkpointed(f(graph, more, ns=ns))).dropDuplicates()
    if titles is not None:
        graph = graph.unionByName(enrich_multilingual(graph, titles, max_entities=max_entities, ns=ns)).dropDuplicates()
    return graph


