"""Column functions: built-in expressions only, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.model import DBPEDIA, NS, YAGO, Namespaces

#: Words in a template's name that tell its type, in the order they are tried.
TYPE_WORDS = ("character", "place", "location", "object", "weapon", "artifact", "book", "event", "battle", "war", "conflict")
#: Title prefixes that are no entities.
EXCLUDED_PREFIXES = ("category:", "file:", "image:", "template:", "wikipedia:", "help:", "special:", "talk:", "user:", "portal:")
#: Words that mark a title of the domain.
DOMAIN_WORDS = ("middle-earth", "tolkien", "lord of the rings", "hobbit", "silmarillion", "arda", "gondor", "rohan", "mordor")
#: Names of languages.
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pl": "Polish", "ru": "Russian", "pt": "Portuguese", "nl": "Dutch", "ja": "Japanese", "zh": "Chinese"}


def trim_ws(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def percent_encode(c: Column, safe: str = "") -> Column:
    """Percent-encoding of UTF-8 bytes; letters, digits, ``_.-~`` and the ``safe`` characters stay."""
    out = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for ch in safe:
        if ch not in "_.-~":
            out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def local_name(c: Column) -> Column:
    """What follows the last slash, and in that the last hash."""
    return F.substring_index(F.substring_index(c, "/", -1), "#", -1)


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def clean_entity_name(c: Column) -> Column:
    """A title as the last part of an IRI."""
    out = F.translate(F.coalesce(c, F.lit("")), "() '", "___")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\-]", "")
    return F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")


def split_on_br(c: Column) -> Column:
    """The parts between line-break tags, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>"), trim_ws)
    return F.filter(parts, lambda x: x != "")


def internal_links(c: Column) -> Column:
    """Targets of flat ``[[target|text]]`` links, in order, without other namespaces and sections."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[([^\[\]|]*)(?:\|[^\[\]]*)?\]\]"), 1), trim_ws)
    other = lambda x: F.lower(x).rlike("^(" + "|".join(EXCLUDED_PREFIXES) + ")") | x.contains("#")
    return F.filter(found, lambda x: ~other(x))


def is_valid_date(c: Column) -> Column:
    """False for dates that say nothing."""
    bare = trim_ws(F.lower(F.coalesce(c, F.lit(""))))
    return ~bare.rlike(r"^(?:[,.\s]*|c\.|around|unknown|late.*age|early.*age)$")


def detect_type(template: Column) -> Column:
    """The entity type that a template's trimmed, lower-case name tells."""
    name = trim_ws(F.lower(template))
    out = F.when(name == "campaign", "war").when(name == "battle", "battle")
    for word in TYPE_WORDS:
        out = out.when(name.contains(word), "war" if word == "conflict" else word)
    return out.otherwise("unknown")


def normalize_name(c: Column) -> Column:
    """A name for comparison: lower case, no straight apostrophes, hyphens and runs of space as one space."""
    out = F.translate(F.lower(F.coalesce(c, F.lit(""))), "-'", " ")
    return trim_ws(F.regexp_replace(out, r"(?U)\s+", " "))


def is_domain_title(title: Column, name: Column) -> Column:
    """Whether a found title is the named entity of the domain; false for a blank name."""
    t, n = F.lower(title), F.lower(name)
    first = F.regexp_extract(n, r"(?U)^\s*(\S+)", 1)
    near = t.contains(n) | t.startswith(first)
    known = (t == n) | t.contains(F.concat(n, F.lit(" (")))
    for word in DOMAIN_WORDS:
        known = known | t.contains(word)
    return F.coalesce((first != "") & near & known, F.lit(False))


def image_name(c: Column) -> Column:
    """A file name without its namespace, each spelling taken off once in turn."""
    out = trim_ws(c)
    for prefix in ("File:", "Image:", "file:", "image:"):
        out = F.regexp_replace(out, f"^{prefix}", "")
    return out


def image_page_url(c: Column, ns: Namespaces = NS) -> Column:
    return F.when(F.length(c) > 0, F.concat(F.lit(f"{ns.wiki}File:"), percent_encode(trim_ws(image_name(c)), "/")))


def image_hash_url(c: Column, ns: Namespaces = NS) -> Column:
    """The address that a file's name alone gives: two folders from its MD5."""
    name = image_name(c)
    digest = F.md5(name.cast("binary"))
    return F.when(F.length(c) > 0, F.concat(F.lit(ns.images), digest.substr(1, 1), F.lit("/"), digest.substr(1, 2), F.lit("/"), percent_encode(name, "/")))


def underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def entity_iri(title: Column, ns: Namespaces = NS) -> Column:
    return F.when(title.isNotNull(), F.concat(F.lit(ns.res), clean_entity_name(title)))


def page_iri(title: Column, ns: Namespaces = NS) -> Column:
    return F.when(title.isNotNull(), F.concat(F.lit(ns.page), clean_entity_name(title)))


def dbpedia_iri(title: Column) -> Column:
    return F.concat(F.lit(DBPEDIA), percent_encode(underscored(title), "_(),-"))


def yago_iri(title: Column) -> Column:
    return F.when(F.length(title) > 0, F.concat(F.lit(YAGO), percent_encode(underscored(title), "_-")))


def wikipedia_url(title: Column) -> Column:
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), percent_encode(underscored(title), "/"))


def language_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.upper(code))
