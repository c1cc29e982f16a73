"""Links to external knowledge bases, as joins with lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import dbpedia_iri, is_domain_title, wikipedia_url, yago_iri
from kgspark.model import WIKIDATA, large

#: What is added to a name for another search, in order.
SUFFIXES = ("", " (Middle-earth)", " (character)", " Tolkien", " Lord of the Rings")
#: Words in an item's description that mark the domain.
DESCRIPTION_WORDS = ("tolkien", "middle-earth", "lord of the rings", "fictional")


def search_variants(names: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(name, variant, query) of distinct names."""
    variants = F.posexplode(F.array(*[F.concat(F.col("name"), F.lit(x)) for x in suffixes])).alias("variant", "query")
    return names.select("name").filter("name IS NOT NULL").distinct().select("name", variants)


def match_wikipedia(names: DataFrame, search_hits: DataFrame, most: int = 5) -> DataFrame:
    """(name, title): the first title of the domain, by variant and then by rank. Hits are tested before the shuffle."""
    found = search_variants(names).join(large(search_hits.filter(F.col("rank") <= most)), "query")
    found = found.filter(is_domain_title(F.col("title"), F.col("name")))
    return found.groupBy("name").agg(F.min(F.struct("variant", "rank", "title"))["title"].alias("title"))


def wikidata_from_title(titles: DataFrame, page_props: DataFrame) -> DataFrame:
    """(name, title, item), item null where the table has none."""
    return titles.join(large(page_props.select("title", F.col("wikibase_item").alias("item"))), "title", "left").select("name", "title", "item")


def wikidata_fallback(names: DataFrame, matched: DataFrame, entity_hits: DataFrame, most: int = 5) -> DataFrame:
    """(name, item) of names without a title: the first hit whose description is of the domain."""
    described = F.lower(F.coalesce("description", F.lit("")))
    domain = F.lit(False)
    for word in DESCRIPTION_WORDS:
        domain = domain | described.contains(word)
    hits = entity_hits.filter((F.col("rank") <= most) & domain)
    left = names.select("name").distinct().join(large(matched), "name", "left_anti")
    return left.join(large(hits), F.col("name") == F.col("query")).groupBy("name").agg(F.min(F.struct("rank", "id"))["id"].alias("item"))


def discover_links(names: DataFrame, search_hits: DataFrame, page_props: DataFrame, entity_hits: DataFrame) -> DataFrame:
    """(name, link_type, uri) of all names: by title, else the item alone."""
    matched = match_wikipedia(names, search_hits)
    titled = wikidata_from_title(matched, page_props)
    link = lambda kind, uri: F.struct(F.lit(kind).alias("link_type"), uri.alias("uri"))
    item = F.concat(F.lit(WIKIDATA), F.col("item"))
    title = F.col("title")
    by_title = titled.select("name", F.explode(F.array(link("wikipedia", wikipedia_url(title)), link("dbpedia", dbpedia_iri(title)), link("yago", yago_iri(title)), link("wikidata", item))).alias("l"))
    by_item = wikidata_fallback(names, matched, entity_hits).select("name", link("wikidata", item).alias("l"))
    return by_title.unionByName(by_item).select("name", "l.*").filter("uri IS NOT NULL")


def linking_summary(names: DataFrame, links: DataFrame) -> DataFrame:
    """One row: distinct names, and those with a link."""
    linked = links.select("name").distinct().withColumn("hit", F.lit(1))
    return names.select("name").distinct().join(large(linked), "name", "left").agg(F.count("*").alias("total"), F.count("hit").alias("found"))


def verify_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links with a flag whether their IRI is a known subject."""
    subjects = known.select("uri").distinct().withColumn("hit", F.lit(True))
    return links.join(large(subjects), "uri", "left").select("name", "link_type", "uri", F.coalesce("hit", F.lit(False)).alias("exists"))
