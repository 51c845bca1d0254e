"""Structured data in web pages: its nodes, lists of items, and event drafts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import kept, let
from ..functions.keys import content_hash
from ..functions.geo import attendance_mode, capacity, location_fields, organization_name, postal_address, with_state
from ..functions.text import clean_text, enum_suffix
from ..functions.times import dates_only, parse_iso, zone_for_offset
from ..functions.urls import canonical_url, url_join

MAX_DESCRIPTION = 5000
_SCRIPT = r"""(?is)<script\b[^>]*?\btype\s*=\s*["']?\s*application/ld\+json\s*(?:;[^"'>]*)?["']?[^>]*>(.*?)</script>"""
_OPENS = r"^\s*(?:<!--|//\s*<!\[CDATA\[|/\*\s*<!\[CDATA\[\s*\*/|<!\[CDATA\[)?"
_CLOSES = r"(?://\s*\]\]>|/\*\s*\]\]>\s*\*/|\]\]>)$"


def _unwrapped(body: Column) -> Column:
    """A script without white space and comment marks around it; what it ends with is looked at before a pattern is."""
    plain = lambda b: F.when(b.endswith("-->"), F.left(b, F.length(b) - 3)).when(b.endswith("]]>") | b.endswith("*/"), F.regexp_replace(b, _CLOSES, "")).otherwise(b)
    return let(F.rtrim(F.regexp_replace(body, _OPENS, ""), F.lit(" \t\n\x0b\f\r")), plain)


def _bodies(html: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)), _unwrapped)


def blocks(pages: DataFrame, page: str = "url", html: str = "html") -> DataFrame:
    """(page, block, body): the structured-data scripts of each page, without comment marks around them."""
    return pages.select(F.col(page).alias("page"), F.posexplode(_bodies(html)).alias("block", "body"))


def _types(node: dict) -> list[str]:
    found = node.get("@type")
    names = found if isinstance(found, list) else [found]
    return [n.replace("#", "/").replace(":", "/").rsplit("/", 1)[-1] for n in names if isinstance(n, str)]


def _walk(value: object, in_event: bool) -> Iterator[tuple[dict, list[str], bool]]:
    """Objects, parents first, with their types and whether one lies in an event."""
    if isinstance(value, list):
        for x in value:
            yield from _walk(x, in_event)
    elif isinstance(value, dict):
        types = _types(value)
        yield value, types, in_event
        inside = in_event or is_event_type(types)
        for x in value.values():
            yield from _walk(x, inside)


def is_event_type(types: list[str]) -> bool:
    return any(t.endswith("Event") or t == "Festival" for t in types)


def _page_nodes(bodies: list[str]) -> Iterator[tuple[dict, list[str], bool]]:
    """_walk() of a page's blocks; what isn't JSON, or is nested beyond Python's depth, is passed over."""
    for body in bodies:
        try:
            yield from list(_walk(json.loads(body), False))
        except (ValueError, RecursionError):
            continue


def nodes(pages: DataFrame, page: str = "url", html: str = "html", of_type: str | None = None) -> DataFrame:
    """(page, pos, types, nested, node): every object of a page's structured data as JSON text, depth first; of one type, or of all.

    nested says that it lies in an event. Blocks that aren't JSON, or are nested beyond Python's depth, are
    passed over. JSON of any shape can't be typed beforehand, so one Arrow pass walks each page's blocks;
    nothing is shuffled, and rows of one url stay apart.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for url, bodies in zip(batch.column("page").to_pylist(), batch.column("bodies").to_pylist()):
                for pos, (node, types, nested) in enumerate(_page_nodes(bodies or [])):
                    if of_type is None or of_type in types:
                        out.append((url, pos, types, nested, json.dumps(node)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["page", "pos", "types", "nested", "node"])

    with_blocks = pages.select(F.col(page).alias("page"), _bodies(html).alias("bodies"))
    return with_blocks.mapInArrow(rows, "page string, pos long, types array<string>, nested boolean, node string")


def event_nodes(found: DataFrame) -> DataFrame:
    """Events that don't lie in other events."""
    return found.where(~F.col("nested") & F.exists("types", lambda t: t.endswith("Event") | (t == "Festival")))


def item_list(found: DataFrame) -> DataFrame:
    """(page, pos, url, item) of every ItemList: its elements' items, given as a url or an object with one."""
    lists = found.where(F.array_contains("types", "ItemList")).select("page", F.col("pos").alias("_list"), F.posexplode(F.from_json(F.get_json_object("node", "$.itemListElement"), "array<string>")).alias("_at", "element"))
    read = lambda item: F.struct(F.when(item.startswith("{"), F.get_json_object(item, "$.url")).otherwise(item).alias("link"), F.when(item.startswith("{"), item).alias("item"))
    entry = let(F.coalesce(F.get_json_object("element", "$.item"), F.col("element")), read)
    rows = lists.select("page", (F.col("_list") * 1_000_000 + F.col("_at")).alias("pos"), kept(entry, lambda r: r["link"].isNotNull() & ~r["link"].startswith("{")).alias("_r"))
    return rows.select("page", "pos", url_join(F.col("page"), F.col("_r.link")).alias("url"), "_r.item")


# Properties of an event, of its places and of its organizers that are kept.
EVENT_KEYS = ["@id", "@type", "description", "endDate", "eventAttendanceMode", "eventStatus", "location", "maximumAttendeeCapacity", "name", "organizer", "previousStartDate", "startDate", "url"]
PLACE_KEYS = ["@type", "address", "geo", "latitude", "longitude", "name", "url"]
ORGANIZER_KEYS = ["@type", "name", "url"]


def slim(node: Column) -> Column:
    """What of an event node is kept, as JSON text: prices, images and the like change without the event changing.

    Places and organizers are cut in the same way, one by one where there are several; other values stay
    whole. Keys come in order at every level, so their order in the page doesn't matter. The node is
    parsed once, and each place and organizer once more.
    """
    row = lambda keys: "struct<" + ", ".join(f"`{k}`: string" for k in keys) + ">"
    cut = lambda value, keys: F.when(value.startswith("{"), F.to_json(F.from_json(value, row(keys)))).otherwise(value)

    def whole(event: Column) -> Column:
        values = {k: event[k] for k in EVENT_KEYS}
        for name, keys in (("location", PLACE_KEYS), ("organizer", ORGANIZER_KEYS)):
            several = F.to_json(F.transform(F.from_json(event[name], "array<string>"), lambda v: cut(v, keys)))  # noqa: B023
            values[name] = F.when(event[name].startswith("["), several).otherwise(cut(event[name], keys))
        return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))

    return let(F.from_json(F.to_json(F.try_parse_json(node)), row(EVENT_KEYS)), whole)


# --- typed events -----------------------------------------------------------------------

#: Columns of a typed event: what drafts are made of, as texts, whatever JSON type a page gives them.
_TEXTS = {"name": "name", "description": "description", "starts": "startDate", "ends": "endDate", "status": "eventStatus", "mode": "eventAttendanceMode", "size": "maximumAttendeeCapacity", "link": "url"}
_PLACE = ["type", "name", "street", "locality", "region", "postal", "country", "address", "plain", "lat", "lon"]
TYPED = ", ".join(f"{c} string" for c in _TEXTS) + ", places array<struct<" + ", ".join(f"{c}: string" for c in _PLACE) + ">>, organizers array<struct<type: string, name: string>>"
_TYPED_ARROW = [pa.string()] * len(_TEXTS) + [pa.list_(pa.struct([(c, pa.string()) for c in _PLACE])), pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))]


def _text(value: object) -> str | None:
    """A value as text: lists and objects as JSON; null is none."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _several(value: object) -> list:
    return [v for v in value if v is not None] if isinstance(value, list) else [] if value is None else [value]


def _inner(value: object, name: str) -> object:
    return value.get(name) if isinstance(value, dict) else None


def _place(value: object) -> dict[str, str | None]:
    if not isinstance(value, dict):
        return {"plain": _text(value)}
    address, geo = value.get("address"), value.get("geo")
    out = {"type": _text(value.get("@type")), "name": _text(value.get("name")), "lat": _text(_inner(geo, "latitude") or value.get("latitude")), "lon": _text(_inner(geo, "longitude") or value.get("longitude"))}
    if not isinstance(address, dict):
        return out | {"address": _text(address)}
    country = address.get("addressCountry")
    country = country.get("name") if isinstance(country, dict) else country
    return out | {c: _text(address.get(k)) for c, k in (("street", "streetAddress"), ("locality", "addressLocality"), ("region", "addressRegion"), ("postal", "postalCode"))} | {"country": _text(country)}


def _typed(node: dict) -> list:
    organizers = [{"type": _text(_inner(o, "@type")), "name": _text(_inner(o, "name"))} for o in _several(node.get("organizer"))]
    return [*(_text(node.get(k)) for k in _TEXTS.values()), [_place(v) for v in _several(node.get("location"))], organizers]


def event_fields(events: DataFrame) -> DataFrame:
    """events with a column for each field that drafts are made of, in place of the JSON text node; one parse a row.

    A text that isn't an object has null fields. Its content_hash, by slim(), is added.
    """
    others = [c for c in events.columns if c != "node"]
    names = [*_TEXTS, "places", "organizers"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("node").to_pylist():
                try:
                    node = json.loads(text) if text else {}
                except (ValueError, RecursionError):
                    node = {}
                found.append(_typed(node if isinstance(node, dict) else {}))
            columns = list(zip(*found)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*others, "content_hash"]), *(pa.array(list(c), k) for c, k in zip(columns, _TYPED_ARROW))], [*others, "content_hash", *names])

    hashed = events.select(*others, "node", content_hash(slim(F.col("node"))).alias("content_hash"))
    types = dict(events.dtypes)
    return hashed.mapInArrow(rows, ", ".join(f"`{c}` {types[c]}" for c in others) + ", content_hash string, " + TYPED)


def page_events(pages: DataFrame, page: str = "url", html: str = "html") -> DataFrame:
    """(page, pos, content_hash, typed columns): events of pages that don't lie in other events, each block parsed once."""
    names = [*_TEXTS, "places", "organizers"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, bodies in zip(batch.column("page").to_pylist(), batch.column("bodies").to_pylist()):
                for pos, (node, types, nested) in enumerate(_page_nodes(bodies or [])):
                    if not nested and is_event_type(types):
                        out.append((url, pos, json.dumps(node), *_typed(node)))
            columns = list(zip(*out)) or [[]] * (3 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.string(), *_TYPED_ARROW])], ["page", "pos", "node", *names])

    with_blocks = pages.select(F.col(page).alias("page"), _bodies(html).alias("bodies"))
    found = with_blocks.mapInArrow(rows, "page string, pos long, node string, " + TYPED)
    return found.select("page", "pos", content_hash(slim(F.col("node"))).alias("content_hash"), *names)


def parse_event_pages(events: DataFrame, only_dates: bool = False, default_state: str | None = None, zone: str = "UTC") -> DataFrame:
    """A draft for each page of events(source_id, page, pos, node) or of page_events() with source_id, with reason where there can be none.

    The node whose own url is the page's, else the first, speaks for a page. An end before the start is
    left out, with only_dates one equal to it too. default_state fills addresses that name no state.
    Fields are read from typed columns, and what several columns of a draft share is worked out once.
    """
    typed = event_fields(events) if "node" in events.columns else events
    fields = ["content_hash", *_TEXTS, "places", "organizers"]
    own = canonical_url(url_join(F.col("page"), F.col("link"))) == canonical_url(F.col("page"))
    chosen = typed.groupBy("source_id", "page").agg(F.min_by(F.struct(*fields), F.struct(F.when(F.coalesce(own, F.lit(False)), 0).otherwise(1), "pos")).alias("n")).select("source_id", "page", "n.*")
    suffix = lambda name: F.regexp_replace(name, r"^.*[/:#]", "")

    def place(p: Column) -> Column:
        posted = postal_address(*[p[c] for c in ("street", "locality", "region", "postal", "country")])
        return F.struct(suffix(p["type"]).alias("type"), clean_text(p["name"]).alias("name"), F.coalesce(p["plain"], p["address"], posted).alias("address"), p["lat"].alias("lat"), p["lon"].alias("lon"))

    read = dates_only if only_dates else parse_iso
    ready = chosen.withColumns({"_at": let(F.transform("places", place), location_fields), "_title": clean_text(F.col("name")), "_start": read(F.col("starts"), F.lit(zone)), "_end": read(F.col("ends"), F.lit(zone))})
    at = F.col("_at")
    late = (F.col("_end") > F.col("_start")) if only_dates else (F.col("_end") >= F.col("_start"))
    address = with_state(at["address"], F.lit(default_state)) if default_state else at["address"]
    organizers = F.transform("organizers", lambda o: F.struct(suffix(o["type"]).alias("type"), clean_text(o["name"]).alias("name")))
    return ready.select(
        "source_id", F.col("page").alias("native_id"), "content_hash", F.col("_title").alias("title"), F.left(clean_text(F.col("description")), F.lit(MAX_DESCRIPTION)).alias("description"),
        F.col("_start").alias("start_utc"), F.when(late, F.col("_end")).alias("end_utc"), zone_for_offset(F.col("starts"), F.lit(zone)).alias("tz"), at["venue"].alias("venue"), address.alias("address"), at["lat"].alias("lat"), at["lon"].alias("lon"),
        attendance_mode(F.col("mode"), at["physical"], at["virtual"]).alias("attendance_mode"), F.when(enum_suffix(F.col("status")) == "EventCancelled", "cancelled").otherwise("scheduled").alias("status"),
        organization_name(organizers).alias("organizer"), F.col("page").alias("url"), F.array().cast("array<string>").alias("kinds"), capacity(F.col("size")).alias("size_signal"),
        F.when(F.col("_title").isNull(), "no name").when(F.col("_start").isNull(), "no start date").alias("reason"))
