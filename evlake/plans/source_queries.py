"""Queries on sources, functions and sinks: rows of the driver's tables are written out as feeds and pages, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, keys, text, times, urls
from ..operators import browse, classify, health, locate, publish, spatial, upsert
from ..operators.storage import spread
from ..sources import ics, jsonld, listings, rules
from ..sources import pages as page_source
from . import run as daily
from .record_queries import _RUNS, _runs
from .registry import query, table, ts
from .view_queries import _FEED, _VERDICTS, _feed, _points, _verdicts


def _k() -> Column:
    return F.col("o_orderkey")


def _c() -> Column:
    return F.col("o_custkey")


def _s(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


# --- calendars --------------------------------------------------------------------

_LOCAL = "l as (select *, o_orderkey as k, o_orderdate + to_hours(cast(8 + o_orderkey % 12 as int)) as moment from orders)"


def _calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar for each customer, with an event for each order: times in UTC, in a zone, as dates and floating."""
    at = F.col("o_orderdate") + _hours(8 + _k() % 12)
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss")
    start = F.when(_k() % 4 == 0, F.concat(F.lit("DTSTART:"), stamp, F.lit("Z"))).when(_k() % 4 == 1, F.concat(F.lit("DTSTART;TZID=America/New_York:"), stamp)).when(
        _k() % 4 == 2, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(at, "yyyyMMdd"))).otherwise(F.concat(F.lit("DTSTART:"), stamp))
    end = F.when(_k() % 3 == 0, F.lit("DURATION:PT1H30M")).when(_k() % 4 == 0, F.concat(F.lit("DTEND:"), F.date_format(at + _hours(_k() % 5 - 1), "yyyyMMdd'T'HHmmss'Z'")))
    place = F.when(_k() % 5 == 0, F.concat(F.lit("LOCATION:https://us02.zoom.us/j/"), _k())).when(_k() % 5 == 3, F.concat(F.lit("LOCATION:https://x.test/"), _k())).when(_k() % 5 != 2, F.concat(F.lit("LOCATION:Hall "), _c()))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:o-"), _k()), F.concat(F.lit("DTSTAMP:20260101T0000"), F.lpad(_s(_k() % 60), 2, "0"), F.lit("Z")), F.concat(F.lit("SEQUENCE:"), _k()), F.when(_k() % 13 != 0, F.concat(F.lit("SUMMARY:Order\\, "), _k())),
        start, end, place, F.when(_k() % 7 == 0, F.lit("GEO:34.5;-118.25")).when(_k() % 7 == 1, F.lit("GEO:95;0")), F.when(_k() % 11 == 0, F.lit("STATUS:CANCELLED")), F.when(_k() % 2 == 1, F.concat(F.lit("DESCRIPTION:See \r\n https://d.test/"), _k(), F.lit("."))), F.lit("END:VEVENT"))
    events = table(spark, sf_dir, "orders").withColumn("event", F.array_join(F.array_compact(lines), "\r\n"))
    body = F.array_join(F.concat(F.array(F.lit("BEGIN:VCALENDAR"), F.lit("X-WR-TIMEZONE:America/Los_Angeles")), F.array_sort(F.collect_list("event")), F.array(F.lit("END:VCALENDAR"))), "\r\n")
    return events.groupBy(F.concat(F.lit("cal-"), _c()).alias("source_id")).agg(body.alias("body")).withColumn("fetched_at", ts("2026-01-01"))


@query("with " + _LOCAL + """
select 'cal-' || o_custkey as source_id, 'o-' || k as native_id, case when k % 13 <> 0 then 'Order, ' || k end as title, start_utc, case when stop >= start_utc then stop end as end_utc, case when k % 4 = 1 then 'America/New_York' else 'America/Los_Angeles' end as tz,
  case when k % 5 in (1, 4) then 'Hall ' || o_custkey end as address, case when k % 7 = 0 then 34.5 end as lat, case when k % 5 = 0 then 'online' when k % 7 = 0 or k % 5 in (1, 4) then 'in_person' else 'unknown' end as attendance_mode,
  case when k % 11 = 0 then 'cancelled' else 'scheduled' end as status, case when k % 5 = 0 then 'https://us02.zoom.us/j/' || k when k % 5 = 3 then 'https://x.test/' || k when k % 2 = 1 then 'https://d.test/' || k end as url,
  case when k % 2 = 1 then 'See https://d.test/' || k || '.' end as description, case when k % 13 = 0 then 'no summary' end as reason
from (select *, case when k % 3 = 0 then start_utc + interval 90 minute when k % 4 = 0 then moment + to_hours(cast(k % 5 - 1 as int)) end as stop
  from (select *, case k % 4 when 0 then moment when 1 then timezone('UTC', timezone('America/New_York', moment)) when 2 then timezone('UTC', timezone('America/Los_Angeles', date_trunc('day', moment)::timestamp)) else timezone('UTC', timezone('America/Los_Angeles', moment)) end as start_utc from l))
""")
def calendar_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = ics.parse_ics(ics.read_ics(_calendars(spark, sf_dir)))
    return drafts.select("source_id", "native_id", "title", "start_utc", "end_utc", "tz", "address", "lat", "attendance_mode", "status", "url", "description", "reason")


# --- structured data in pages --------------------------------------------------------


def _event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: an event among other data, and links; its name, address and times in the forms that pages use."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = lambda name: F.lit(name).alias("@type")
    address = F.struct(kind("PostalAddress"), F.concat(_k() % 90 + 1, F.lit(" Main St")).alias("streetAddress"), F.lit("Irvine").alias("addressLocality"), F.when(_k() % 3 != 0, F.lit("CA")).alias("addressRegion"), F.lit("US").alias("addressCountry"))
    geo_ = F.when(_k() % 4 == 0, F.struct(F.lit("33.5").alias("latitude"), F.lit("-117.5").alias("longitude")))
    place = F.to_json(F.struct(kind("Place"), F.concat(F.lit("Hall "), _c()).alias("name"), address.alias("address"), geo_.alias("geo"), F.concat(F.lit("https://img.test/"), _k()).alias("image")))
    virtual = F.lit('{"@type":"VirtualLocation","url":"https://z.test"}')
    where = F.when(_k() % 6 == 0, virtual).when(_k() % 6 == 1, F.concat(F.lit("["), virtual, F.lit(","), place, F.lit("]"))).otherwise(place)
    people = F.lit('[{"@type":"Person","name":"Someone"},{"@type":"schema:Organization","name":"Org &amp; Co"}]')
    start = F.when(_k() % 5 == 0, F.concat(F.lit('"'), day, F.lit('"'))).when(_k() % 5 == 1, F.concat(F.lit('"'), day, F.lit('T18:00:00Z"'))).otherwise(F.concat(F.lit('"'), day, F.lit('T18:00:00+02:00"')))
    stop = F.concat(F.lit('"'), day, F.when(_k() % 2 == 0, F.lit('T23:00:00Z"')).otherwise(F.lit('T01:00:00Z"')))
    name = F.when(_k() % 17 != 0, F.concat(F.lit('"name":"Order &#35;<b>'), _k(), F.lit('</b>  &amp; more",'))).otherwise(F.lit(""))
    event = F.concat(
        F.lit('{"@type":["Thing","https://schema.org/MusicEvent"],'), name, F.lit('"startDate":'), start, F.lit(',"endDate":'), stop, F.lit(',"url":"/e/'), _k(), F.lit('?utm_source=z","location":'), where, F.lit(',"organizer":'), people,
        F.lit(',"eventStatus":"https://schema.org/'), F.when(_k() % 7 == 0, F.lit("EventCancelled")).otherwise(F.lit("EventScheduled")), F.lit('","maximumAttendeeCapacity":"'), _k() % 50 - 1, F.lit('","image":"https://i.test/'), _k(), F.lit('","subEvent":{"@type":"Event","name":"inner"}}'))
    items = F.concat(F.lit('{"@type":"ItemList","itemListElement":[{"item":{"url":"/e/'), _k() + 1, F.lit('","name":"next"}},"/e/'), _k() + 2, F.lit('"]}'))
    script = F.concat(F.lit('<script type="application/ld+json;charset=utf-8"><!-- {"@graph":[{"@type":"Event","name":"other","url":"/other"},'), event, F.lit(","), items, F.lit("]} --></script>"))
    html = F.concat(F.lit("<html><head>"), F.lit('<script type="application/ld+json">{broken</script>'), script, F.lit('</head><a href="/e/'), _k() + 3, F.lit('#top">x</a></html>'))
    return spread(table(spark, sf_dir, "orders")).select(_k(), F.concat(F.lit("https://p.test/e/"), _k()).alias("url"), html.alias("html"), F.col("o_orderdate"))


@query("""
with o as (select *, o_orderkey as k, case o_orderkey % 5 when 0 then timezone('UTC', timezone('America/Los_Angeles', o_orderdate)) when 1 then o_orderdate + interval 18 hour else o_orderdate + interval 16 hour end as start_utc,
  o_orderdate + case when o_orderkey % 2 = 0 then interval 23 hour else interval 1 hour end as stop from orders)
select 'https://p.test/e/' || k as native_id, case when k % 17 <> 0 then 'Order # ' || k || ' & more' end as title, start_utc, case when stop >= start_utc then stop end as end_utc,
  case when k % 6 <> 0 then 'Hall ' || o_custkey end as venue, case when k % 6 <> 0 then (k % 90 + 1) || ' Main St, Irvine' || ', CA' || ', US' end as address, case when k % 6 <> 0 and k % 4 = 0 then 33.5 end as lat,
  case when k % 6 = 0 then 'online' when k % 6 = 1 then 'hybrid' else 'in_person' end as attendance_mode, case when k % 7 = 0 then 'cancelled' else 'scheduled' end as status, 'Org & Co' as organizer,
  case when k % 50 > 0 then k % 50 - 1 end as size_signal, case when k % 17 = 0 then 'no name' end as reason from o
""")
def page_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pages, each by the node whose own url is the page's; a state is filled in where none is named."""
    found = jsonld.page_events(_event_pages(spark, sf_dir)).withColumn("source_id", F.lit("s"))
    drafts = jsonld.parse_event_pages(found, default_state="CA", zone="America/Los_Angeles")
    return drafts.select("native_id", "title", "start_utc", "end_utc", "venue", "address", "lat", "attendance_mode", "status", "organizer", "size_signal", "reason")


@query("""
select o_orderkey, true as same_slim, o_orderkey % 2 = 0 as same_hash from orders
""")
def slim_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose images, prices and key order changed keep their slim form; a changed name does not."""
    place = lambda image: F.concat(F.lit('{"name":"Hall","image":"'), image, F.lit('","@type":"Place"}'))
    first = F.concat(F.lit('{"name":"A","startDate":"2026-10-01","offers":{"price":'), _k(), F.lit('},"location":'), place(_s(_k())), F.lit(',"organizer":[{"@type":"Person","name":"P","email":"x"}]}'))
    second = F.concat(F.lit('{"organizer":[{"name":"P","@type":"Person"}],"startDate":"2026-10-01","location":{"@type":"Place","image":"q","name":"Hall"},"name":"A","image":"'), _k(), F.lit('"}'))
    third = F.when(_k() % 2 == 0, second).otherwise(F.replace(second, F.lit('"name":"A"'), F.lit('"name":"B"')))
    slim = lambda j: keys.content_hash(jsonld.slim(j))
    return table(spark, sf_dir, "orders").select(_k(), (slim(first) == slim(second)).alias("same_slim"), (slim(first) == slim(third)).alias("same_hash"))


@query("""
with k as (select o_orderkey as k, o_orderkey % 10 as s from orders), p as (select k, s, row_number() over (order by k) as page_ord from k),
c as (select s, k, page_ord, 0 as rank, 0 as pos, k + 4 as t, null as item from p union all select s, k, page_ord, 1, 0, k + 1, '{"url":"/e/' || (k + 1) || '","name":"next"}' from p union all select s, k, page_ord, 1, 1, k + 2, null from p union all select s, k, page_ord, 2, 0, k + 3, null from p),
f as (select s, t, min(row(page_ord, rank, pos)) as first_at, arg_min(coalesce(item, '-'), row(page_ord, rank, pos)) as item from c where t % 10 < 8 group by s, t),
r as (select s, t, item, row_number() over (partition by s order by first_at) as place from f)
select 's' || s as source_id, 'https://p.test/e/' || t as url, cast(place as int) as place, nullif(item, '-') as item from r where place <= 40
""")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, item lists and fixed urls of listing pages in one order, with what the lists say of a page."""
    listing = _event_pages(spark, sf_dir)
    source = F.concat(F.lit("s"), F.regexp_extract("page", r"(\d)$", 1))
    order = F.regexp_extract("page", r"(\d+)$", 1).cast("bigint").alias("page_ord")
    links = page_source.page_links(listing).select(source.alias("source_id"), "page", order, F.col("pos").cast("bigint").alias("pos"), "url")
    items = jsonld.item_list(jsonld.nodes(listing, of_type="ItemList")).select(source.alias("source_id"), "page", order, "pos", "url", "item")
    # places within the list, not within the page
    items = items.withColumn("pos", F.pmod("pos", F.lit(1_000_000)))
    fixed = listing.select(F.concat(F.lit("s"), _k() % 10).alias("source_id"), F.col("url").alias("page"), _k().alias("page_ord"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("https://p.test/e/"), _k() + 4).alias("url"))
    return page_source.frontier(page_source.candidates(links, items, fixed), r"/e/\d*[0-7]$", 40).select("source_id", "url", "place", "item")


# --- listings in JSON --------------------------------------------------------------


@query("""
select 's' as source_id, cast(o_orderkey as varchar) as native_id, 'Order ' || o_orderkey as title, timezone('UTC', timezone('America/Chicago', o_orderdate + interval 18 hour)) as start_utc, 'America/Chicago' as tz,
  case when o_orderkey % 3 = 0 then 'Springfield, IL' else o_custkey || ' Elm St, Springfield, IL' end as address, case when o_orderkey % 5 <> 0 then o_orderkey % 90 + 0.5 end as lat,
  case o_orderkey % 5 when 0 then 'online' when 1 then 'hybrid' when 2 then 'in_person' else 'unknown' end as attendance_mode, case when o_orderstatus = 'F' then 'cancelled' else 'scheduled' end as status, 'Group ' || o_custkey as organizer, 'https://m.test/' || o_orderkey as url, o_orderkey % 100 as size_signal
from orders
""")
def search_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search results that find some events twice."""
    kind = F.element_at(F.array(*map(F.lit, ["ONLINE", "HYBRID", "PHYSICAL", "OTHER", "?"])), (_k() % 5 + 1).cast("int"))
    venue = F.struct(F.lit("V").alias("name"), F.when(_k() % 3 != 0, F.concat(_c(), F.lit(" Elm St"))).alias("address"), F.lit(" Springfield").alias("city"), F.lit("IL").alias("state"), (_k() % 90 + 0.5).alias("lat"), F.lit(-100.5).alias("lon"))
    node = F.struct(
        _s(_k()).alias("id"), F.concat(F.lit(" Order "), _k()).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'18:00").alias("dateTime"), kind.alias("eventType"), F.when(F.col("o_orderstatus") == "F", F.lit("CANCELLED")).otherwise("ACTIVE").alias("status"),
        F.concat(F.lit("https://M.test/"), _k(), F.lit("?ref=q#x")).alias("eventUrl"), F.struct((_k() % 100).alias("totalCount")).alias("rsvps"), venue.alias("venue"), F.struct(F.concat(F.lit("Group "), _c()).alias("name"), F.lit("America/Chicago").alias("timezone")).alias("group"))
    again = F.struct(_s(_k()).alias("id"), F.lit("seen again").alias("title"))
    edges = F.concat(F.lit('{"data":{"eventSearch":{"edges":['), F.concat_ws(",", *[F.to_json(F.struct(n.alias("node"))) for n in (node, again)]), F.lit("]}}}"))
    pages = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_id"), _k().alias("page"), edges.alias("body"))
    drafts = listings.parse_search(listings.read_search(pages, include_online=True))
    return drafts.select("source_id", "native_id", "title", "start_utc", "tz", "address", "lat", "attendance_mode", "status", "organizer", "url", "size_signal")


@query("""
select cast(o_orderkey as varchar) as native_id, 'Order ' || o_orderkey as title, 'About ' || o_orderkey as description, o_orderdate + interval 18 hour as start_utc, o_orderdate + interval 20 hour as end_utc,
  case when o_orderkey % 2 = 0 then 'Shown, Irvine, CA' else o_custkey || ' Elm St, Irvine, CA, 92618' end as address, case when o_orderkey % 3 <> 0 then 33.25 end as lat, case when o_orderkey % 7 = 0 then 'online' else 'in_person' end as attendance_mode,
  case when o_orderstatus = 'F' then 'cancelled' else 'scheduled' end as status, 'Host' as organizer, o_orderkey % 300 as size_signal from orders
""")
def organizer_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.struct(F.when(_k() % 2 == 0, F.lit("Shown, Irvine, CA")).alias("localized_address_display"), F.concat(_c(), F.lit(" Elm St")).alias("address_1"), F.lit("Irvine").alias("city"), F.lit("CA").alias("region"), F.lit("92618").alias("postal_code"))
    at = lambda hour: F.struct(F.lit("America/Los_Angeles").alias("timezone"), F.date_format("o_orderdate", f"yyyy-MM-dd'T'{hour}:00:00'Z'").alias("utc"))
    event = F.struct(
        _s(_k()).alias("id"), F.struct(F.concat(F.lit("Order "), _k()).alias("text")).alias("name"), F.struct(F.concat(F.lit("About "), _k()).alias("text")).alias("description"), at(18).alias("start"), at(20).alias("end"), F.when(F.col("o_orderstatus") == "F", F.lit("canceled")).otherwise("live").alias("status"),
        (_k() % 7 == 0).alias("online_event"), (_k() % 300).alias("capacity"), F.struct(F.lit("V").alias("name"), address.alias("address"), F.when(_k() % 3 != 0, F.lit("33.25")).otherwise("x").alias("latitude"), F.lit("-117.5").alias("longitude")).alias("venue"), F.struct(F.lit("Host").alias("name")).alias("organizer"))
    pages = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_id"), _k().alias("page"), F.to_json(F.struct(F.array(event, event).alias("events"))).alias("body"))
    return listings.parse_organizer(listings.read_organizer(pages)).select("native_id", "title", "description", "start_utc", "end_utc", "address", "lat", "attendance_mode", "status", "organizer", "size_signal")


@query("""
select 'https://h.test/' || o_orderkey as native_id, case when o_orderkey % 2 = 0 then ['hackathon'] else ['hackathon', 'meetup'] end as kinds, 'Org ' || o_custkey as organizer, case when o_orderkey % 3 = 0 then o_orderkey % 40 else o_orderkey % 70 end as size_signal from orders where o_orderkey % 4 <> 0
""")
def listing_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of orders with the drafts of their pages; pages that no listing knows are left out."""
    item = lambda mark: F.struct(_k().alias("id"), F.concat(F.lit("https://H.test/"), _k(), F.lit(mark)).alias("url"), F.concat(F.lit("Org "), _c()).alias("organization_name"), (_k() % 70).alias("registrations_count"))
    orders = table(spark, sf_dir, "orders")
    lists = orders.where("o_orderkey % 4 <> 0").select(F.lit("s").alias("source_id"), _k().alias("page"), F.to_json(F.struct(F.array(item("?ref=a"), item("#b")).alias("hackathons"))).alias("body"))
    drafts = orders.select(
        F.lit("s").alias("source_id"), F.concat(F.lit("https://h.test/"), _k()).alias("native_id"), F.when(_k() % 2 == 0, F.array(F.lit("hackathon"))).otherwise(F.array(F.lit("meetup"))).alias("kinds"), F.lit("page's own").alias("organizer"), F.when(_k() % 3 == 0, _k() % 40).alias("size_signal"))
    return listings.with_pages(listings.read_listing(lists), drafts).select("native_id", "kinds", "organizer", "size_signal")


@query("""
select cast(o_orderkey as varchar) as native_id, 'Hack ' || o_orderkey as title, timezone('UTC', timezone('America/New_York', o_orderdate)) as start_utc, case when o_orderkey % 3 = 0 then 'Main Hall' when o_orderkey % 3 = 1 then 'Austin, TX, United States' else 'Austin, TX' end as address,
  case when o_orderkey % 4 = 1 then 'hybrid' else 'in_person' end as attendance_mode, case when o_orderkey % 2 = 0 then 'https://own.test/' || o_orderkey else 'https://l.test/x/' || o_orderkey end as url, ['hackathon'] as kinds from orders where o_orderkey % 4 <> 0
""")
def season_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events in the data of a page; online ones are left out."""
    home = F.when(_k() % 3 != 0, F.struct(F.lit("Austin").alias("city"), F.lit("Texas").alias("state"), F.when(_k() % 3 == 1, F.lit("US")).otherwise("ZZ").alias("country")))
    event = F.struct(
        _s(_k()).alias("id"), F.concat(F.lit("Hack "), _k()).alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("startsAt"), F.concat(F.lit("x/"), _k()).alias("url"), F.lit("Main Hall").alias("location"), F.when(_k() % 4 == 0, F.lit("digital")).when(_k() % 4 == 1, F.lit("hybrid")).otherwise("physical").alias("formatType"),
        F.when(_k() % 2 == 0, F.concat(F.lit("https://own.test/"), _k())).otherwise("http://plain.test").alias("websiteUrl"), home.alias("venueAddress"))
    html = F.concat(F.lit('<script data-page="app" type="application/json">{"props":{"upcomingEvents":['), F.to_json(event), F.lit("]}}</script>"))
    pages = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_id"), F.lit("https://l.test/").alias("page"), html.alias("html"))
    # one page for all events shares its address, so places on it come from the keys
    rows, _ = listings.read_page_data(pages)
    return listings.parse_page_data(rows, "America/New_York").select("native_id", "title", "start_utc", "address", "attendance_mode", "url", "kinds")


# --- configuration and adapters --------------------------------------------------------


@query("""
with s as (select 's' || (s_suppkey // 2 * 2) as source_id, case when s_suppkey % 5 = 0 then 'what' else 'ics' end as adapter, case when s_suppkey % 7 = 0 then 'r9' when s_suppkey % 7 = 1 then 'r1' end as keep_region from supplier),
p as (select 'p' || c_custkey as profile_id, 'r' || (c_custkey % 4) as region_id, 't' || (c_custkey % 3) as topic_id, 's' || (c_custkey % 200) as uses from customer)
select source_id as subject, 'repeated source' as problem from s group by 1 having count(*) > 1
union select source_id, 'unknown adapter ' || adapter from s where adapter <> 'ics'
union select source_id, 'unknown region ' || keep_region from s where keep_region = 'r9'
union select profile_id, 'unknown region ' || region_id from p where region_id = 'r3'
union select profile_id, 'unknown topic ' || topic_id from p where topic_id = 't2'
union select profile_id, 'unknown source ' || uses from p where uses not in (select source_id from s)
union select profile_id, 'unknown trusted source ' || uses from p where uses not in (select source_id from s)
""")
def rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources and customers as profiles: everything that is wrong with them."""
    s = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.floor(s / 2) * 2).alias("source_id"), F.when(s % 5 == 0, F.lit("what")).otherwise("ics").alias("adapter"), F.when(s % 7 == 0, F.lit("r9")).when(s % 7 == 1, F.lit("r1")).alias("keep_region"))
    c = F.col("c_custkey")
    used = F.array(F.concat(F.lit("s"), c % 200))
    profiles = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), c).alias("profile_id"), F.concat(F.lit("r"), c % 4).alias("region_id"), F.concat(F.lit("t"), c % 3).alias("topic_id"), used.alias("sources"), used.alias("trust"))
    names = lambda prefix, n, column: spark.range(n).select(F.concat(F.lit(prefix), "id").alias(column))
    return rules.check_rules(sources, profiles, names("r", 3, "region_id"), names("t", 2, "topic_id"), ["ics"])


@query("""
select case when o_orderkey % 2 = 0 then 'even' else 'odd' end as source_id, cast(o_orderkey as varchar) as native_id, case when o_orderkey % 2 = 0 then upper(o_orderstatus) else lower(o_orderstatus) end as title, case when o_orderkey % 2 = 1 and o_orderkey % 9 = 0 then 'ValueError: no number' end as error from orders
""")
def adapter_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two sources by their own adapters, one an expression and one a plain parser that fails on some records, in one table."""
    raw = table(spark, sf_dir, "orders").select(F.when(_k() % 2 == 0, F.lit("even")).otherwise("odd").alias("source_id"), _s(_k()).alias("native_id"), F.col("o_orderstatus").alias("payload"))

    def parsed(record: dict) -> list[dict]:
        if int(record["native_id"]) % 9 == 0:
            raise ValueError("no number")
        return [{"title": record["payload"].lower()}]

    def lower(rows: DataFrame) -> DataFrame:
        return rules.parse_each(rows, parsed, "title string").withColumn("source_id", F.lit("odd"))

    def upper(rows: DataFrame) -> DataFrame:
        return rows.select("source_id", "native_id", F.upper("payload").alias("title"), F.lit(None).cast("string").alias("error"))

    sources = spark.createDataFrame([("even", "upper"), ("odd", "lower")], "source_id string, adapter string")
    drafts = daily.drafts_of_adapters({"upper": upper, "lower": lower}, sources)(raw)
    title = F.coalesce("title", F.when(F.col("error").isNotNull(), F.lower(F.lit(None).cast("string"))))
    back = raw.select("source_id", "native_id", "payload")
    return drafts.withColumn("title", title).join(back, ["source_id", "native_id"]).select("source_id", "native_id", F.coalesce("title", F.lower("payload")).alias("title"), "error")


# --- functions ----------------------------------------------------------------------

_URL = "u as (select page_id, page_id % 8 as f, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '(\\?[^#]*)', 1) as q from pages)"


@query("with " + _URL + """
select page_id, case f when 0 then 'https://other.test/x' when 1 then scheme || '://cdn.test/y' when 2 then root || path || q when 3 then root || path || q || '#s' when 4 then root || path || '?z=1' when 5 then root || '/b/d?w' when 6 then root || regexp_extract(path, '^(.*/)', 1) || 'near' else root || '/up' end as joined from u
""")
def url_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every form as seen from each page."""
    links = ["https://other.test/x", "//cdn.test/y", "", "#s", "?z=1", "/a/../b/./c/../d?w", "near", "../../../../../../up"]
    link = F.element_at(F.array(*map(F.lit, links)), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.url_join(F.col("url"), link).alias("joined"))


@query("""
select page_id, url as first, true as whole, page_id % 3 = 0 as meeting from pages
""")
def url_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link of a text, whether a text is one link, and whether it leads to a meeting."""
    url, n = F.col("url"), F.col("page_id")
    host = F.element_at(F.array(F.lit("https://us02.zoom.us/j/"), F.lit("https://a.test/"), F.lit("zoom.us ")), (n % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.first_url(F.concat(F.lit("See "), url, F.lit(",. and https://z.test/"), n)).alias("first"), (urls.is_url(url) & ~urls.is_url(F.concat(url, F.lit(" x")))).alias("whole"), urls.is_meeting_url(F.concat(host, n)).alias("meeting"))


_ISO = "e as (select event_id, date_trunc('second', ts) as t, event_id % 4 as f from events)"


@query("with " + _ISO + """,
p as (select *, case f when 0 then t when 1 then timezone('UTC', timezone('America/Chicago', date_trunc('day', t)::timestamp)) when 2 then timezone('UTC', timezone('America/Chicago', t)) else t - interval 330 minute end as instant from e)
select event_id, instant, cast(case f when 0 then 0 when 3 then 330 end as int) as minutes, timezone('UTC', timezone('America/Chicago', date_trunc('day', t)::timestamp)) as midnight, strftime(instant, '%Y-%m-%dT%H:%M:%S.%f+00:00') as stored, instant as read_back,
  case when f = 0 then null when f = 3 then 'Asia/Kolkata' end as zone from p
""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in four forms and read again."""
    t, f, zone = F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("event_id") % 4, F.lit("America/Chicago")
    stamp = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    value = F.when(f == 0, F.concat(stamp, F.lit("Z"))).when(f == 1, F.concat(F.lit(" "), F.date_format(t, "yyyy-MM-dd"))).when(f == 2, stamp).otherwise(F.concat(stamp, F.lit("+05:30")))
    rows = table(spark, sf_dir, "events").select("event_id", f.alias("f"), value.alias("v"))
    instant = times.parse_iso(F.col("v"), zone)
    return rows.select("event_id", instant.alias("instant"), F.when(f.isin(0, 3), times.offset_minutes(F.col("v"))).alias("minutes"), times.dates_only(F.col("v"), zone).alias("midnight"), times.db_text(instant).alias("stored"), times.from_db_text(times.db_text(instant)).alias("read_back"), F.when(F.col("f").isin(0, 3), times.zone_for_offset(F.col("v"), F.lit("Asia/Kolkata"))).alias("zone"))


@query("""
with e as (select event_id, ['America/Los_Angeles', 'America/Denver', 'America/New_York'][event_id % 3 + 1] as zone, case when event_id % 5 = 0 then timezone('UTC', timezone(['America/Los_Angeles', 'America/Denver', 'America/New_York'][event_id % 3 + 1], date_trunc('day', ts)::timestamp)) else date_trunc('minute', ts) end as t, case when event_id % 5 <> 0 then date_trunc('minute', ts) + to_hours(cast(event_id % 30 as int)) end as u from events),
l as (select *, timezone(zone, timezone('UTC', t)) as a, timezone(zone, timezone('UTC', u)) as b, (epoch(timezone(zone, timezone('UTC', t))) - epoch(t)) / 60 as off from e),
r as (select *, case when event_id % 5 = 0 then 'All day' else strftime(a, '%-I:%M %p') || ' – ' || case when a::date <> b::date then strftime(b, '%b %-d, ') else '' end || strftime(b, '%-I:%M %p') end as span from l)
select event_id, strftime(a, '%A, %B %-d, %Y') as heading, event_id % 5 = 0 as whole_day, coalesce(a::date <> b::date, false) as spans, span, strftime(a, '%a, %b %-d, ') || span as label,
  strftime(a, '%a, %b %-d %Y, %-I:%M %p ') || ['P', 'M', 'E'][event_id % 3 + 1] || case when off = [-480, -420, -300][event_id % 3 + 1] then 'ST' else 'DT' end as rss from r
""")
def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How events of three zones are shown; some last all day, some beyond midnight."""
    zone = F.element_at(F.array(*map(F.lit, ["America/Los_Angeles", "America/Denver", "America/New_York"])), (F.col("event_id") % 3 + 1).cast("int"))
    t = F.col("ts").cast("timestamp")
    whole = F.col("event_id") % 5 == 0
    start = F.when(whole, F.to_utc_timestamp(F.date_trunc("day", t), zone)).otherwise(F.date_trunc("minute", t))
    end = F.when(~whole, F.date_trunc("minute", t) + _hours(F.col("event_id") % 30))
    rows = table(spark, sf_dir, "events").select("event_id", start.alias("s"), end.alias("e"), zone.alias("z"))
    s, e, z = F.col("s"), F.col("e"), F.col("z")
    return rows.select("event_id", times.day_heading(s, z).alias("heading"), times.all_day(s, e, z).alias("whole_day"), times.spans_days(s, e, z).alias("spans"), times.time_range(s, e, z).alias("span"), times.when_label(s, e, z).alias("label"), times.rss_when(s, z).alias("rss"))


@query("""
select p_partkey, p_name || ' & ' || p_brand || chr(10) || 'x' as plain, p_type as suffix, [p_type, 'Thing', 'Event'] as types, cast(case when p_size % 3 = 0 then p_size end as bigint) as size from part
""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit(" <p>"), "p_name", F.lit("</p> &amp;\t <i>"), "p_brand", F.lit("</i> \n &#120; "))
    types = F.array(F.concat(F.lit("https://schema.org/"), "p_type"), F.lit("schema:Thing"), F.lit("Event"))
    size = F.when(F.col("p_size") % 3 == 0, _s("p_size")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("-"), _s("p_size"))).otherwise("many")
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_text(html).alias("plain"), text.enum_suffix(F.concat(F.lit("https://schema.org/"), "p_type")).alias("suffix"), text.type_names(types).alias("types"), geo.capacity(size).alias("size"))


_HOMES = "c as (select c_custkey as k, c_mktsegment as town, c_custkey % 50 || ' Oak Ave' as street from customer)"


@query("with " + _HOMES + """
select k, street || ', ' || town || ', CA 92507' as postal, case when k % 3 = 0 then street || ', ' || town || ', CA, USA' when k % 3 = 1 then street || ', ' || town || ', NV, USA' else street || ', ' || town || ', Germany' end as stated,
  case when k % 3 = 2 then null else town end as city, case when k % 5 = 0 then 'Online' when k % 3 = 2 then 'Hall · Area' else 'Hall · ' || town end as label, case when k % 5 = 0 then 'Online' when k % 3 = 2 then 'Area' else town end as area,
  case when k % 7 = 0 then 'online' when k % 7 = 1 then 'hybrid' when k % 7 = 2 then 'in_person' when k % 7 = 3 then 'online' else 'unknown' end as mode, case when k % 4 <> 0 then 'Org' end as organizer from c
""")
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as towns: addresses joined, completed and read again."""
    k = F.col("c_custkey")
    homes = spread(table(spark, sf_dir, "customer")).select(k.alias("k"), F.col("c_mktsegment").alias("town"), F.concat(k % 50, F.lit(" Oak Ave")).alias("street"))
    k, town, street = F.col("k"), F.col("town"), F.col("street")
    postal = geo.postal_address(F.concat(street, F.lit(", "), F.lower(town)), F.upper(town), F.lit(" CA 92507 "), F.lit("92507"), F.lit(None).cast("string"))
    raw = F.when(k % 3 == 0, F.concat(street, F.lit(", "), town, F.lit(", USA"))).when(k % 3 == 1, F.concat(street, F.lit(", "), town, F.lit(", NV, USA"))).otherwise(F.concat(street, F.lit(", "), town, F.lit(", Germany")))
    stated = geo.with_state(raw, F.lit("CA"))
    mode = F.when(k % 5 == 0, F.lit("online")).otherwise("in_person")
    declared = F.when(k % 7 == 0, F.lit("https://schema.org/OnlineEventAttendanceMode"))
    physical, virtual = (k % 7).isin(1, 2), (k % 7).isin(1, 3)
    people = F.array(F.struct(F.lit("Person").alias("type"), F.lit("P").alias("name")), F.struct(F.when(k % 4 == 0, F.lit("Person")).otherwise("Organization").alias("type"), F.lit("Org").alias("name")))
    city = lambda a: geo.city_of(a)
    # the first address repeats the town in another spelling, which is not added again
    return homes.select("k", F.replace(postal, F.lower(town), town).alias("postal"), stated.alias("stated"), city(stated).alias("city"), geo.place_label(mode, F.lit("Hall"), stated, F.lit("Area")).alias("label"), geo.area_of_event(mode, stated, F.lit("Area")).alias("area"), geo.attendance_mode(declared, physical, virtual).alias("mode"), geo.organization_name(people).alias("organizer"))


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then ['Luma'] when o_orderkey % 3 = 1 then ['Meetup', 'Luma'] else ['own-9'] end as platforms, case when o_orderkey % 3 = 0 then 'Luma' when o_orderkey % 3 = 1 then 'Meetup' else 'own-9' end as listed, 's:' || o_orderkey as record,
  case when o_orderkey % 4 = 0 then 3 when o_orderkey % 4 = 1 then 1 when o_orderkey % 4 = 2 then 2 else 0 end as rank from orders
""")
def platform_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"luma-": "Luma", "meetup-": "Meetup"}
    ids = F.when(_k() % 3 == 0, F.array(F.lit("luma-a"), F.lit("luma-b"))).when(_k() % 3 == 1, F.array(F.lit("meetup-x"), F.lit("luma-a"), F.lit("meetup-y"))).otherwise(F.array(F.lit("own-9")))
    precision = F.element_at(F.array(F.lit(None).cast("string"), F.lit("postal"), F.lit("place"), F.lit("address")), (_k() % 4 + 1).cast("int"))
    lat = F.when(_k() % 4 != 0, F.lit(1.0))
    return table(spark, sf_dir, "orders").select(_k(), geo.platforms(ids, names).alias("platforms"), geo.platform_of(ids, names).alias("listed"), keys.record_key(F.lit("s"), _k()).alias("record"), geo.location_rank(lat, precision).alias("rank"))


# --- entities and places ----------------------------------------------------------------


@query("""
with d as (select o_orderkey as k, o_orderkey % 3 as g, case when o_orderkey % 2 = 0 then 'https://p.test/' || (o_orderkey // 12) end as url, o_orderdate as start_utc from orders),
e as (select 'paged-' || k as event_id, url, start_utc::date as day from d where g = 1 and k % 4 = 0),
p as (select url, day, min(event_id) as paged from e group by 1, 2),
n as (select d.*, p.paged from d left join p on d.url = p.url and d.start_utc::date = p.day),
w as (select *, min(k) over (partition by coalesce(url, 's:' || k), start_utc::date, g = 0 or paged is not null) as first_k from n)
select cast(k as varchar) as native_id, case when g = 0 then 'linked-' || k when paged is not null then paged else '20261001000000000' || '00002' || lpad(cast(first_k as varchar), 19, '0') end as event_id from w
""")
def attached_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts: some are known by their record, some by their page and day, and the rest make new events."""
    d = table(spark, sf_dir, "orders").select(
        F.lit("s").alias("source_id"), _s(_k()).alias("native_id"), F.when(_k() % 2 == 0, F.concat(F.lit("https://p.test/"), F.floor(_k() / 12))).alias("url"), F.col("o_orderdate").cast("timestamp").alias("start_utc"), F.lit(2).alias("source_index"), _k().alias("pos"))
    links = d.where("pos % 3 = 0").select("source_id", "native_id", F.concat(F.lit("linked-"), "native_id").alias("event_id"))
    events = d.where("pos % 3 = 1 and pos % 4 = 0").select(F.concat(F.lit("paged-"), "native_id").alias("event_id"), "url", "start_utc")
    return upsert.attach_events(d, links, events, "2026-10-01").select("native_id", "event_id")


@query("""
select 'a' || c_custkey as alias_id, case when c_custkey % 3 = 0 then 'w' || (c_custkey % 100) else 's' || (c_custkey % 100) end as event_id from customer where c_custkey % 100 % 3 = 0 and c_custkey % 3 = 0
union all select 'a' || c_custkey, 's' || (c_custkey % 100) from customer where not (c_custkey % 100 % 3 = 0 and c_custkey % 3 = 0)
union all select distinct 's' || (c_custkey % 100), 'w' || (c_custkey % 100) from customer where c_custkey % 100 % 3 = 0 and c_custkey % 3 = 0
""")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as aliases of a hundred entities, some of which are merged into others by now."""
    from ..operators import folds

    c = F.col("c_custkey")
    merged = (c % 100 % 3 == 0) & (c % 3 == 0)
    base = table(spark, sf_dir, "customer")
    aliases = base.select(F.concat(F.lit("a"), c).alias("alias_id"), F.when(merged, F.concat(F.lit("s"), c % 100)).otherwise(F.concat(F.lit("s"), c % 100)).alias("event_id"), F.lit(1).alias("merged_at"), merged.alias("m"))
    # losers are the merged ones' own entities, named apart from those that stay
    aliases = aliases.withColumn("event_id", F.when(F.col("m"), F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id"))).drop("m")
    merges = base.where(merged).select(F.concat(F.lit("xs"), c % 100).alias("loser"), F.concat(F.lit("w"), c % 100).alias("survivor"), F.lit(2).alias("merged_at")).distinct()
    return folds.resolve_aliases(aliases, merges).select(F.regexp_replace("alias_id", "^xs", "s").alias("alias_id"), "event_id")


_ZONES = """z(name, x1, x2) as (values ('Etc/GMT', 0.0, 3.0), ('Zone/A', 2.0, 6.0), ('Zone/B', 5.0, 12.0))"""


@query("with p as (select event_id, (user_id % 100) / 10.0 + value / 100000 as lon, event_id % 4 = 0 as known from events)," + _ZONES + """
select event_id, case when lon < 2 then null when lon < 6 then 'Zone/A' else 'Zone/B' end as found_tz from p where not known
""")
def point_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcoming events without a zone, by the zone polygon that holds them; zones of the sea give none."""
    from ..sources import geojson

    ring = lambda a, b: f"[[[{a},-1],[{b},-1],[{b},9],[{a},9]]]"
    feature = lambda name, a, b: f'{{"type":"Feature","properties":{{"name":"{name}"}},"geometry":{{"type":"Polygon","coordinates":{ring(a, b)}}}}}'
    body = '{"type":"FeatureCollection","features":[' + ",".join([feature("Etc/GMT", 0, 3), feature("Zone/A", 2, 6), feature("Zone/B", 5, 12)]) + "]}"
    zones = geojson.polygons(spark.createDataFrame([("zones", body)], "region_id string, body string"))
    events = _points(spark, sf_dir).withColumns({"tz": F.when(F.col("event_id") % 4 == 0, F.lit("UTC")), "start_utc": ts("2026-10-02"), "end_utc": F.lit(None).cast("timestamp")})
    return spatial.zone_of_points(locate.missing_zones(events, ts("2026-10-01")).select("event_id", "lat", "lon"), zones, ["event_id"]).select("event_id", "found_tz")


@query("""
with a as (select distinct o_custkey % 300 as n, ['IL', 'California', 'Texas'][o_custkey % 3 + 1] as st, 10000 + o_custkey % 40 as zip, min(o_orderdate) over (partition by o_custkey % 300, o_custkey % 3, o_custkey % 40) as first_start from orders where o_orderkey % 5 <> 0),
d as (select *, lower('suite ' || n || ', springfield, ' || st || ' ' || zip) as address_key, n % 4 <> 0 as asks from a),
q as (select *, asks and row_number() over (partition by asks order by first_start, address_key) <= 50 as asked from d),
r as (select *, case when n % 4 = 0 then n::double when asked and n % 3 = 0 then 5.0 when zip % 3 = 0 and st <> 'Texas' then zip / 1000.0 when st in ('IL', 'California') then 39.0 end as lat,
  case when n % 4 = 0 then 'address' when asked and n % 3 = 0 then 'address' when zip % 3 = 0 and st <> 'Texas' then 'postal' when st in ('IL', 'California') then 'place' end as precision from q)
select address_key, lat, precision from r where precision is not null
""")
def found_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a place: by a cache, by a service for the first fifty addresses, by postal code, by town."""
    from .view_queries import _addresses

    orders = _addresses(spark, sf_dir)
    online = _k() % 5 == 0
    events = orders.select("address", "start_utc", F.lit(None).cast("timestamp").alias("end_utc"), F.lit(None).cast("double").alias("lat"), F.when(online, F.lit("online")).otherwise("in_person").alias("attendance_mode"))
    key = geo.address_key(F.col("address"))
    n = F.regexp_extract("address_key", r"suite (\d+)", 1).cast("int")
    cache = events.select(key.alias("address_key")).distinct().where(n % 4 == 0).select("address_key", n.cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.lit(None).cast("string").alias("precision"), ts("1990-01-01").alias("looked_up_at"))
    zips = spark.range(10000, 10040).where("id % 3 = 0").select(F.col("id").cast("string").alias("zip"), (F.col("id") / 1000).alias("lat"), F.lit(1.0).alias("lon"))
    places = spark.createDataFrame([("IL", "springfield", 39.0, 1.0), ("CA", "springfield", 39.0, 2.0)], "state string, place string, lat double, lon double")
    service = lambda asked: asked.where(n % 3 == 0).select("address_key", F.lit(5.0).alias("lat"), F.lit(6.0).alias("lon"))
    return locate.enrich(events, cache, zips, places, ts("1980-01-01"), service, budget=50).select("address_key", "lat", "precision")


@query("""
with k as (select o_orderkey, array_sort(list_distinct(list_filter(['talk', case when o_orderkey % 2 = 0 then 'meetup' end, case when o_orderkey % 3 = 0 then 'conference' end, case when o_orderkey % 5 = 0 then 'talk' end], lambda x: x is not null))) as kinds from orders) select o_orderkey, list_sort(kinds) as kinds from k
""")
def all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array_compact(F.array(F.lit("talk"), F.when(_k() % 2 == 0, F.lit("meetup"))))
    ruled = F.array_compact(F.array(F.when(_k() % 3 == 0, F.lit("conference")), F.when(_k() % 5 == 0, F.lit("talk"))))
    return table(spark, sf_dir, "orders").select(_k(), classify.published_kinds(own, ruled).alias("kinds"))


@query("""
with p as (select event_id, event_type, (user_id % 100) / 10.0 + value / 100000 as lon, (event_id % 70) / 10.0 + 0.013 as lat, event_id % 6 = 0 as lost from events)
select event_id from p where event_type <> 'click' or (not lost and lon between 0 and 4 and lat between 0 and 4)
""")
def kept_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a source bound to a region, border included: those outside it, and those without a place, are dropped."""
    from ..sources import geojson

    body = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4]]]}'
    region = geojson.polygons(spark.createDataFrame([("box", body)], "region_id string, body string"))
    lost = F.col("event_id") % 6 == 0
    types = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source_id"))
    drafts = _points(spark, sf_dir).join(types, "event_id").select("event_id", "source_id", _s("event_id").alias("native_id"), F.when(~lost, F.col("lat")).alias("lat"), F.when(~lost, F.col("lon")).alias("lon"))
    sources = types.select("source_id").distinct().withColumn("keep_region", F.when(F.col("source_id") == "click", F.lit("box")))
    return daily.keep_region(drafts, sources, region, border=True).select("event_id")


# --- health -----------------------------------------------------------------------------

_STATE = _VERDICTS + """,
i as (select *, len(reasons) = 0 as healthy, sum(case when len(reasons) = 0 then 1 else 0 end) over (partition by source_id order by started_at) as island from v),
s as (select *, sum(case when healthy then 0 else 1 end) over (partition by source_id, island order by started_at) as streak, min(case when not healthy then started_at end) over (partition by source_id, island order by started_at) as first_bad from i)
"""


@query("with " + _STATE + """,
l as (select source_id, case when healthy then 'healthy' when streak >= 2 then 'disabled' else 'unhealthy' end as state, case when not healthy then first_bad end as since, started_at as last_probe, row_number() over (partition by source_id order by started_at desc) as k from s)
select source_id, state, since, state <> 'disabled' or last_probe <= timestamp '2024-02-03' as fetch from l where k = 1
""")
def fetched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources the next run reads: all but those that are disabled and were tried within a week."""
    judged = health.states(_verdicts(spark, sf_dir), alert_after=2, disable_after=2)
    last = judged.groupBy("source_id").agg(F.max_by(F.struct("state", "since"), F.struct("started_at", "run_id")).alias("s"), F.max("started_at").alias("last_probe")).select("source_id", "s.state", "s.since", "last_probe")
    return health.select_sources(last.select("source_id"), last, ts("2024-02-10")).select("source_id", "state", "since", "fetch")


@query("with " + _VERDICTS + """,
e as (select event_type as source_id, date_trunc('day', ts)::timestamp as started_at, cast(event_id as varchar) as native_id, row_number() over (partition by event_type, date_trunc('day', ts) order by cast(event_id as varchar)) as k from events)
select v.source_id, strftime(v.started_at, '%Y%m%d') as run_id, list_sort(list(native_id)) as records from v join e on v.source_id = e.source_id and v.started_at = e.started_at where len(reasons) > 0 and k <= 10 group by 1, 2
""")
def drift_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten records of each unhealthy run."""
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.date_format("ts", "yyyyMMdd").alias("run_id"), _s("event_id").alias("native_id"), F.col("props").alias("payload"))
    found = health.drift_samples(_verdicts(spark, sf_dir).where("not healthy"), raw)
    return found.select("source_id", "run_id", F.transform("records", lambda r: r["native_id"]).alias("records"))


@query("with " + _STATE + """,
l as (select *, coalesce(lag(streak) over (partition by source_id order by started_at), 0) as before from s)
select source_id, strftime(started_at, '%Y%m%d') as run_id, case when healthy then 'resolve' else 'alert' end as action, 'Source ' || source_id || case when healthy then ' recovered' when streak >= 4 then ' is disabled' else ' is unhealthy' end as title from l where (not healthy and streak in (2, 4)) or (healthy and before >= 2)
""")
def source_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.alerts(health.states(_verdicts(spark, sf_dir), alert_after=2, disable_after=4)).select("source_id", "run_id", "action", "title")


# --- feeds ------------------------------------------------------------------------------

_NOW = "1998-06-01"
_UPCOMING = _FEED + ", u as (select * from f where start_utc >= timestamp '1998-06-01')"


def _full_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = {c: F.lit(None).cast("string") for c in ("description", "url", "address", "tz")}
    return _feed(spark, sf_dir).withColumns({"title": F.concat(F.lit("Order, <"), F.col("event_id"), F.lit(">")), "venue": F.col("profile_id"), "lat": F.lit(1.5), "lon": F.lit(2.5), "kinds": F.array(F.lit("talk"), F.lit("meetup")), **plain})


@query("with " + _UPCOMING + """,
r as (select *, row_number() over (partition by profile_id order by start_utc, event_id) as k from u)
select profile_id, '{"count":' || count(*) || ',"events":[' as value from u group by 1
union all select profile_id, '],"generated_at":"1998-06-01T00:00:00.000000+00:00","profile":{"id":"' || profile_id || '","name":"' || profile_id || '"},"schema_version":1}' from u group by 1
union all select profile_id, case when k > 1 then ',' else '' end || '{"event_id":"' || event_id || '","first_seen":"' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S.000') || '","start_utc":"' || strftime(start_utc, '%Y-%m-%dT%H:%M:%S.000') || '","status":"' || status || '"}' from r
""")
def feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each nation's JSON document."""
    return publish.json_document(_feed(spark, sf_dir).drop("end_utc"), ts(_NOW))


@query("with " + _UPCOMING + """
select profile_id, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'PRODID:-//evlake//EN', 'VERSION:2.0', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'X-WR-CALNAME:' || profile_id, 'X-PUBLISHED-TTL:PT12H') as value from u group by profile_id
union all select profile_id, 'END:VCALENDAR' from u group by profile_id
union all select profile_id, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || event_id, 'DTSTAMP:19980601T000000Z', 'DTSTART:' || strftime(start_utc, '%Y%m%dT%H%M%SZ'), 'SUMMARY:Order\\, <' || event_id || '>', 'LOCATION:' || profile_id, 'GEO:1.5;2.5', 'STATUS:' || case when status = 'cancelled' then 'CANCELLED' else 'CONFIRMED' end, 'CATEGORIES:meetup,talk', 'END:VEVENT') from u
""")
def feed_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each nation's calendar."""
    return publish.ics_document(_full_feed(spark, sf_dir), ts(_NOW))


@query("""
with t as (select s_suppkey, repeat('é', cast(s_suppkey * 7 % 200 as int)) as body from supplier)
select s_suppkey, array_to_string(list_prepend('X:' || left(body, 36), list_transform(range(36, greatest(length(body), 36), 37), lambda i: substr(body, i + 1, 37))), chr(13) || chr(10) || ' ') as line from t
""")
def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar lines of letters of two octets."""
    length = (F.col("s_suppkey") * 7 % 200).cast("int")
    return table(spark, sf_dir, "supplier").select("s_suppkey", publish.fold_line(F.concat(F.lit("X:"), F.repeat(F.lit("é"), length))).alias("line"))


@query("with " + _UPCOMING + """,
r as (select *, timezone('America/Los_Angeles', timezone('UTC', start_utc)) as a, row_number() over (partition by profile_id order by first_seen desc, event_id desc) as place from u)
select profile_id, '<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>' || profile_id || '</title><link>https://site.test/</link><description>New events: ' || profile_id || '</description><lastBuildDate>Mon, 01 Jun 1998 00:00:00 +0000</lastBuildDate>' as value from u group by profile_id
union all select profile_id, '</channel></rss>' from u group by profile_id
union all select profile_id, '<item><title>Order, &lt;' || event_id || '&gt;</title><guid isPermaLink="false">' || event_id || '</guid><pubDate>' || strftime(first_seen, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate><description>' || case when status = 'cancelled' then 'CANCELLED' || chr(10) else '' end || strftime(a, '%a, %b %-d %Y, %-I:%M %p ') || case when epoch(a) - epoch(start_utc) = -28800 then 'PST' else 'PDT' end || chr(10) || profile_id || '</description><category>meetup</category><category>talk</category></item>' from r where place <= 100
""")
def feed_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each nation's channel."""
    return publish.rss_document(_full_feed(spark, sf_dir), ts(_NOW), site="https://site.test/")


@query("with " + _UPCOMING + "," + _RUNS + """,
c as (select profile_id, count(*) as upcoming, count(*) filter (where first_seen >= timestamp '1998-05-25') as new from u group by 1),
l as (select string_agg('{"source_id":"' || source_id || '","status":"' || status || '","fetched":' || fetched || ',"changed":' || parsed || ',"parsed":' || parsed || ',"parse_errors":' || parse_errors || '}', ',' order by source_id) as listed from runs where started_at = timestamp '2024-01-05')
select profile_id, '{"counts":{"new":' || new || ',"upcoming":' || upcoming || '},"run_id":"20240105","schema_version":1,"sources":[' || listed || ']}' as value from c, l
""")
def feed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run says of itself for each nation, with the figures of all sources."""
    runs = _runs(spark, sf_dir).where("run_id = '20240105'")
    return publish.manifest(publish.feed_counts(_feed(spark, sf_dir), ts(_NOW)), runs, "20240105")


@query("with " + _UPCOMING + """,
n as (select *, 'Order ' || event_id as title, case when cast(event_id as bigint) % 5 = 0 then 'Online' when cast(event_id as bigint) % 5 = 1 then 'Location not listed' else 'Town ' || (cast(event_id as bigint) % 5) end as heading from u),
m as (select *, row_number() over (order by case heading when 'Online' then 1 when 'Location not listed' then 2 else 0 end, lower(heading), start_utc, event_id, profile_id) as k, count(*) over () as matched from n where contains(lower(title), '1') and contains(lower(title), 'order') and cast(event_id as bigint) % 2 = 0)
select event_id, heading, cast(2 as int) as page, cast(ceil(matched / 50.0) as int) as pages, cast(51 as int) as first, cast(least(100, matched) as int) as last, cast(matched as int) as matched, cast((select count(*) from u) as int) as total from m where k between 51 and 100
""")
def browse_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the upcoming orders that contain two words and are of a kind, under their towns."""
    n = F.col("event_id").cast("bigint")
    feed = _feed(spark, sf_dir).withColumns({
        "title": F.concat(F.lit("Order "), F.col("event_id")), "venue": F.lit(None).cast("string"), "organizer": F.lit(None).cast("string"), "tz": F.lit(None).cast("string"), "area": F.lit(None).cast("string"), "source_ids": F.array(F.lit("s")),
        "kinds": F.when(n % 2 == 0, F.array(F.lit("talk"))).otherwise(F.array(F.lit("meetup"))), "attendance_mode": F.when(n % 5 == 0, F.lit("online")).otherwise("in_person"), "address": F.when(n % 5 > 1, F.concat(F.lit("X St, Town "), n % 5, F.lit(", CA 92507")))})
    shown = browse.browse(feed, "order 1", "talk", "city", "50", 2)
    return shown.select("event_id", "heading", "page", "pages", "first", "last", "matched", "total")


@query("""
with h as (select doc_id, case when doc_id % 2 = 0 then upper(source) else source end as heading, row_number() over (partition by lower(source) order by doc_id) as place from documents)
select doc_id, cast(place as int) as place from h
""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order under their sources, however spelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"))
    return browse.placed_in_groups(docs, F.col("source"), ["doc_id"]).select("doc_id", "place")
