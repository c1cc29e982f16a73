"""The wikitext helper: balanced templates and links of a page, in one vectorised pass."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import EXCLUDED_PREFIXES, detect_type

#: Templates that hold a year of a calendar.
CALENDARS = ("FA", "SA", "TA", "FoA", "YT", "YS", "VY")
_HIDDEN = re.compile(r"<!--.*?-->|<nowiki>.*?</nowiki>", re.S)
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]")
_MARKS_OR = {mark: re.compile(_MARK.pattern + "|" + re.escape(mark)) for mark in "|="}
#: Values without markup, entities, quotes or white space other than single spaces are their own display text.
_PLAIN = re.compile(r"[^\[\]{}<>&'\s]+(?: [^\[\]{}<>&'\s]+)*")


def spans(text: str, opening: str = "{{", closing: str = "}}") -> list[tuple[int, int]]:
    """(first, past) of what stands between balanced marks, outer before inner, in order of their beginnings."""
    found, open_ = [], []
    if opening not in text:
        return found
    for m in _MARK.finditer(text):
        if m.group() == opening:
            open_.append(m.end())
        elif m.group() == closing and open_:
            found.append((open_.pop(), m.start()))
    return sorted(found)


def fields(body: str, mark: str = "|") -> list[str]:
    """A template's or link's body split at marks outside of inner ones."""
    if not _MARK.search(body):
        return body.split(mark)
    parts, depth, last = [], 0, 0
    for m in _MARKS_OR[mark].finditer(body):
        found = m.group()
        if found == mark:
            if depth == 0:
                parts.append(body[last : m.start()])
                last = m.end()
        else:
            depth += 1 if found in ("{{", "[[") else -1
    return [*parts, body[last:]]


def _pair(part: str) -> list[str]:
    """A field split at its first equals sign outside of inner templates and links; without one, the field alone."""
    key, sign, value = part.partition("=")
    if not sign:
        return [part]
    if not _MARK.search(key):
        return [key, value]
    key, *value = fields(part, "=")
    return [key, "=".join(value)] if value else [part]


def visible(text: str) -> str:
    """Text without comments; what nowiki tags hold can't open anything."""
    if "<" not in text:
        return text
    return _HIDDEN.sub(lambda m: "" if m.group().startswith("<!--") else html.escape(m.group()[8:-9]).replace("{", "&#123;").replace("[", "&#91;"), text)


def infobox(text: str | None) -> tuple[str, dict[str, str]] | None:
    """(lower-case name, parameters) of the first infobox, campaign or battle template; empty parameters are dropped."""
    text = visible(text or "")
    for first, past in spans(text):
        name, *rest = fields(text[first:past])
        name = name.strip().lower()
        if "infobox" in name or name in ("campaign", "battle"):
            params: dict[str, str] = {}
            for place, part in enumerate(rest, 1):
                *key, value = _pair(part)
                value = value.strip()
                if value:
                    params[key[0].strip().lower() if key else str(place)] = value
            return name, params
    return None


def strip_code(text: str) -> str:
    """Display text: templates and comments vanish, links leave their text, quotes of bold and italics vanish."""
    text = visible(text)
    for first, past in sorted(spans(text), reverse=True):
        if text[first - 2 : first] == "{{" and text[past : past + 2] == "}}":
            text = text[: first - 2] + text[past + 2 :]
    for first, past in sorted(spans(text, "[[", "]]"), reverse=True):
        end = text.find("]]", first)
        text = text[: first - 2] + fields(text[first:end])[-1] + text[end + 2 :]
    if "//" in text:
        text = re.sub(r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]]*))?\]", lambda m: m.group(1) or "", text)
    return html.unescape(re.sub(r"'{2,}", "", text))


def clean_wikitext(text: str | None) -> str:
    if text and _PLAIN.fullmatch(text):
        return text.strip('"')
    plain = re.sub(r"<[^>]+>", "", re.sub(r"\[\d+\]", "", strip_code(text or "")))
    return re.sub(r"\s+", " ", plain).strip().strip("\"'")


def internal_links(text: str | None) -> list[str]:
    if not text or "[[" not in text:
        return []
    text = visible(text or "")
    titles = (fields(text[a:b])[0].strip() for a, b in spans(text, "[[", "]]"))
    return [t for t in titles if not t.lower().startswith(EXCLUDED_PREFIXES) and "#" not in t]


def clean_date(text: str | None) -> str:
    if text and _PLAIN.fullmatch(text):
        return text
    text = visible(text or "")
    for first, past in spans(text):
        name, *rest = fields(text[first:past])
        if name.strip() in CALENDARS and rest:
            year = re.sub(r"\[.*?\]", "", rest[0].strip())
            return f"{name.strip()} {re.sub(r'<ref[^>]*>.*?</ref>', '', year, flags=re.S)}".strip()
    plain = re.sub(r"<ref[^>]*>.*?</ref>", "", strip_code(text), flags=re.S)
    return re.sub(r"\[.*?\]", "", plain).strip()


PARSED = "template string, params map<string,string>, plain map<string,string>, links map<string,array<string>>, dates map<string,string>"
_READINGS = {"plain": clean_wikitext, "links": internal_links, "dates": clean_date}


def _maps(own: list[dict | None], kind: pa.DataType) -> pa.Array:
    """An Arrow column of maps, from flat lists of their keys and values; None is null."""
    starts: list[int | None] = []
    keys, values = [], []
    for x in own:
        starts.append(None if x is None else len(keys))
        if x:
            keys.extend(x)
            values.extend(x.values())
    return pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(values, kind))


def _reader(f: Callable, keys: tuple[str, ...] | None) -> Callable:
    """``f`` of a page's parameters, of all or of those named."""
    if keys is None:
        return lambda p: {k: f(v) for k, v in p.items()}
    return lambda p: {k: f(p[k]) for k in keys if k in p}


def parse_pages(pages: DataFrame, readings: tuple[str, ...] | dict[str, tuple[str, ...]] = ("plain", "links", "dates")) -> DataFrame:
    """Pages with their infobox: template, params, and per parameter the plain text, links and date.

    Only pages that may hold an infobox go through Python, each once; the others get nulls.
    ``readings`` names the columns that are wanted besides template and params, so that what
    nothing reads isn't made; as a dict, also the parameters that each is wanted of. Adds itype
    (null without an infobox) and status: success, no_infobox or no_page. Extra columns are kept.
    """
    may = F.coalesce(F.col("wikitext").rlike("(?i)infobox|campaign|battle"), F.lit(False))
    columns = pages.columns
    wanted = [x for x in PARSED.split(", ") if x.split(" ")[0] in ("template", "params", *readings)]
    readers = {name: _reader(_READINGS[name], readings[name] if isinstance(readings, dict) else None) for name in _READINGS if name in readings}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [infobox(t) for t in batch.column("wikitext").to_pylist()]
            own = [b[1] if b else None for b in boxes]
            made = {"template": pa.array([b[0] if b else None for b in boxes], pa.string()), "params": _maps(own, pa.string())}
            for name, read in readers.items():
                made[name] = _maps([None if p is None else read(p) for p in own], pa.list_(pa.string()) if name == "links" else pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], names=[*batch.schema.names, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    parsed = pages.filter(may).mapInArrow(parse, ", ".join([kinds, *wanted]))
    nulls = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ", 1) for x in wanted)]
    rest = pages.filter(~may).select(*columns, *nulls)
    status = F.when(F.col("wikitext").isNull(), "no_page").when(F.col("template").isNull(), "no_infobox").otherwise("success")
    return parsed.unionByName(rest).withColumn("itype", F.when(F.col("template").isNotNull(), detect_type(F.col("template")))).withColumn("status", status)
