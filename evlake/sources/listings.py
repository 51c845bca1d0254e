"""Feeds in JSON: search results, organizers' events, hackathon listings and page data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import literal_map
from ..functions.geo import STATES, joined_address, valid_coordinates
from ..functions.times import parse_iso
from ..functions.urls import canonical_url, url_join

SEARCH = "struct<data: struct<eventSearch: struct<edges: array<struct<node: struct<id: string, title: string, description: string, dateTime: string, endTime: string, eventType: string, status: string, eventUrl: string, rsvps: struct<totalCount: bigint>, venue: struct<name: string, address: string, city: string, state: string, postalCode: string, country: string, lat: string, lon: string>, `group`: struct<name: string, urlname: string, timezone: string>>>>>>>"
ORGANIZER = "struct<events: array<struct<id: string, name: struct<text: string>, description: struct<text: string>, url: string, start: struct<timezone: string, utc: string>, `end`: struct<timezone: string, utc: string>, status: string, online_event: boolean, capacity: bigint, venue: struct<name: string, address: struct<localized_address_display: string, address_1: string, city: string, region: string, postal_code: string, country: string, latitude: string, longitude: string>, latitude: string, longitude: string>, organizer: struct<name: string>>>>"
LISTING = "struct<hackathons: array<struct<id: bigint, title: string, url: string, submission_period_dates: string, organization_name: string, invite_only: boolean, registrations_count: bigint>>>"
SEASON = "struct<props: struct<upcomingEvents: array<struct<id: string, name: string, startsAt: string, endsAt: string, url: string, location: string, formatType: string, websiteUrl: string, venueAddress: struct<city: string, state: string, country: string>>>>>"
# Statuses that mean an event won't take place.
CANCELLED = ["CANCELLED", "CANCELLED_PERM", "AUTOSCHED_CANCELLED"]
# Country codes that addresses spell out.
COUNTRIES = {"US": "United States", "CA": "Canada", "GB": "United Kingdom", "IN": "India", "MX": "Mexico", "DE": "Germany", "FR": "France"}
MAX_DESCRIPTION = 5000


def _first(rows: DataFrame, by: str, cap: int | None) -> DataFrame:
    """The first record of each id of a source in discovery order, at most cap, the source's own request limit."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("source_id", by).orderBy("page", "pos"))).where("_k = 1").drop("_k")
    if cap is None:
        return first
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("page", "pos"))).where(F.col("_n") <= cap).drop("_n")


def _draft(rows: DataFrame, native: Column, **values: Column) -> DataFrame:
    plain = {k: F.lit(None).cast(t) for k, t in {"description": "string", "end_utc": "timestamp", "tz": "string", "venue": "string", "address": "string", "lat": "double", "lon": "double", "organizer": "string", "size_signal": "bigint"}.items()}
    named = plain | {"attendance_mode": F.lit("in_person"), "status": F.lit("scheduled"), "kinds": F.array().cast("array<string>")} | values
    order = ["title", "description", "start_utc", "end_utc", "tz", "venue", "address", "lat", "lon", "attendance_mode", "status", "organizer", "url", "kinds", "size_signal"]
    title, start = named["title"], named["start_utc"]
    reason = F.when(title.isNull() | (F.trim(title) == ""), "no title").when(start.isNull(), "no start")
    return rows.select("source_id", native.alias("native_id"), *[named[c].alias(c) for c in order], reason.alias("reason"))


def read_search(pages: DataFrame, include_online: bool = False, cap: int | None = None) -> DataFrame:
    """(source_id, page, pos, node) of search results (source_id, page, body): an event once, whichever searches find it."""
    rows = pages.select("source_id", "page", F.posexplode(F.from_json("body", SEARCH)["data"]["eventSearch"]["edges"]).alias("pos", "e")).select("source_id", "page", "pos", F.col("e.node").alias("node")).where("node.id is not null")
    wanted = rows if include_online else rows.where("coalesce(node.eventType, '') <> 'ONLINE'")
    return _first(wanted.withColumn("_id", F.col("node.id")), "_id", cap).drop("_id")


def parse_search(rows: DataFrame, default_tz: str = "UTC") -> DataFrame:
    n = F.col("node")
    zone = F.coalesce(n["group"]["timezone"], F.lit(default_tz))
    online = n["eventType"] == "ONLINE"
    at = valid_coordinates(n["venue"]["lat"], n["venue"]["lon"])
    mode = F.when(online, "online").when(n["eventType"] == "HYBRID", "hybrid").when(n["eventType"] == "PHYSICAL", "in_person").otherwise("unknown")
    return _draft(
        rows, n["id"], title=F.trim(n["title"]), description=F.left(n["description"], F.lit(MAX_DESCRIPTION)), start_utc=parse_iso(n["dateTime"], zone), end_utc=parse_iso(n["endTime"], zone), tz=zone, venue=n["venue"]["name"],
        address=joined_address(*[n["venue"][p] for p in ("address", "city", "state", "postalCode")]), lat=F.when(~online, at["lat"]), lon=F.when(~online, at["lon"]), attendance_mode=mode,
        status=F.when(n["status"].isin(CANCELLED), "cancelled").otherwise("scheduled"), organizer=n["group"]["name"], url=canonical_url(n["eventUrl"]), size_signal=n["rsvps"]["totalCount"])


def read_organizer(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """(source_id, page, pos, event) of organizers' pages (source_id, page, body), each event once."""
    rows = pages.select("source_id", "page", F.posexplode(F.from_json("body", ORGANIZER)["events"]).alias("pos", "event")).where("event.id is not null")
    return _first(rows.withColumn("_id", F.col("event.id")), "_id", cap).drop("_id")


def parse_organizer(rows: DataFrame, default_tz: str = "UTC") -> DataFrame:
    e = F.col("event")
    a = e["venue"]["address"]
    zone = F.coalesce(e["start"]["timezone"], F.lit(default_tz))
    at = valid_coordinates(F.coalesce(e["venue"]["latitude"], a["latitude"]), F.coalesce(e["venue"]["longitude"], a["longitude"]))
    return _draft(
        rows, e["id"], title=F.trim(e["name"]["text"]), description=F.left(e["description"]["text"], F.lit(MAX_DESCRIPTION)), start_utc=parse_iso(e["start"]["utc"], F.lit("UTC")), end_utc=parse_iso(e["end"]["utc"], F.lit("UTC")), tz=zone,
        venue=e["venue"]["name"], address=F.coalesce(a["localized_address_display"], joined_address(a["address_1"], a["city"], a["region"], a["postal_code"])), lat=at["lat"], lon=at["lon"],
        attendance_mode=F.when(e["online_event"], "online").otherwise("in_person"), status=F.when(e["status"] == "canceled", "cancelled").otherwise("scheduled"), organizer=e["organizer"]["name"], url=canonical_url(e["url"]), size_signal=e["capacity"])


def read_listing(listings: DataFrame, cap: int | None = None) -> DataFrame:
    """(source_id, page, pos, item, url) of listings (source_id, page, body), each canonical page once."""
    rows = listings.select("source_id", "page", F.posexplode(F.from_json("body", LISTING)["hackathons"]).alias("pos", "item")).withColumn("url", canonical_url(F.col("item.url"))).where("url is not null")
    return _first(rows, "url", cap)


def with_pages(listing: DataFrame, page_drafts: DataFrame) -> DataFrame:
    """Drafts of pages whose listing knows them: always a hackathon, the listing's organizer and, where the page has none, its size."""
    items = listing.select("source_id", F.col("url").alias("native_id"), F.col("item.organization_name").alias("_by"), F.col("item.registrations_count").alias("_size"))
    joined = page_drafts.withColumn("native_id", canonical_url(F.col("native_id"))).join(items, ["source_id", "native_id"])
    return joined.withColumns({"kinds": F.array_sort(F.array_union("kinds", F.array(F.lit("hackathon")))), "organizer": F.col("_by"), "size_signal": F.coalesce("size_signal", "_size")}).drop("_by", "_size")


def read_page_data(pages: DataFrame, include_online: bool = False, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of season pages (source_id, page, html): rows(source_id, page, pos, event, base); pages without data are errors."""
    body = F.regexp_extract("html", r"""(?is)<script\b[^>]*\bdata-page\s*=\s*["']app["'][^>]*>(.*?)</script>""", 1)
    parsed = pages.withColumn("_e", F.from_json(body, SEASON)["props"]["upcomingEvents"])
    rows = parsed.select("source_id", "page", F.posexplode("_e").alias("pos", "event")).where("event.id is not null")
    if not include_online:
        rows = rows.where("coalesce(event.formatType, '') <> 'digital'")
    return _first(rows.withColumn("_id", F.col("event.id")), "_id", cap).drop("_id"), parsed.where("_e is null").select("source_id", F.lit("no page data").alias("error"))


def parse_page_data(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    e = F.col("event")
    country = F.try_element_at(literal_map(COUNTRIES), e["venueAddress"]["country"])
    state = F.coalesce(F.try_element_at(literal_map({v: k for k, v in STATES.items()}), e["venueAddress"]["state"]), e["venueAddress"]["state"])
    site = F.when(F.lower(e["websiteUrl"]).startswith("https://"), e["websiteUrl"]).otherwise(url_join(F.col("page"), e["url"]))
    mode = F.when(e["formatType"] == "digital", "online").when(e["formatType"] == "hybrid", "hybrid").otherwise("in_person")
    return _draft(
        rows, e["id"], title=F.trim(e["name"]), start_utc=parse_iso(e["startsAt"], F.lit(zone)), end_utc=parse_iso(e["endsAt"], F.lit(zone)), address=F.coalesce(joined_address(e["venueAddress"]["city"], state, country), F.nullif(F.trim(e["location"]), F.lit(""))),
        attendance_mode=mode, url=canonical_url(site), kinds=F.array(F.lit("hackathon")))
