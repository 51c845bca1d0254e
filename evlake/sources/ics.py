"""Calendar feeds: one raw record for each event, and drafts from them."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.geo import valid_coordinates
from ..functions.times import duration_seconds
from ..functions.urls import first_url, is_meeting_url, is_url

MAX_DESCRIPTION = 5000
ZONES = sorted(available_timezones())


def read_ics(feeds: DataFrame) -> DataFrame:
    """Raw records of feeds(source_id, body, fetched_at): (source_id, native_id, content_hash, payload, fetched_at).

    DTSTAMP and SEQUENCE change with every download and are left out. An event without UID is named by
    its text; an override of a recurring one by UID and its own time.
    """
    unfolded = F.regexp_replace("body", r"\r?\n[ \t]", "")
    zone = F.nullif(F.trim(F.regexp_extract(unfolded, r"(?m)^X-WR-TIMEZONE[^:\r\n]*:([^\r\n]*)", 1)), F.lit(""))
    rules = F.array_join(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VTIMEZONE.*?END:VTIMEZONE"), F.lit(0)), "\n")
    events = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT.*?END:VEVENT"), F.lit(0))
    rows = feeds.select("source_id", "fetched_at", zone.alias("zone"), rules.alias("zones"), F.posexplode(events).alias("pos", "event"))
    kept = rows.withColumn("event", F.regexp_replace("event", r"(?m)^(?:DTSTAMP|SEQUENCE)[^\r\n]*\r?\n", ""))
    again = F.regexp_extract("event", r"(?m)^RECURRENCE-ID[^:\r\n]*:(\S+)", 1)
    moment = F.regexp_replace(F.regexp_replace(again, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), r"T(\d{2})(\d{2})(\d{2})Z?", "T$1:$2:$3")
    uid = F.nullif(F.trim(prop(F.col("event"), "UID")), F.lit(""))
    named = F.concat(F.coalesce(uid, F.concat(F.lit("sha256:"), F.sha2("event", 256))), F.when(again != "", F.concat(F.lit("#"), moment)).otherwise(""))
    payload = F.to_json(F.struct("event", "zone", "zones"))
    return kept.select("source_id", named.alias("native_id"), F.sha2(payload, 256).alias("content_hash"), payload.alias("payload"), "fetched_at", "pos")


def prop(event: Column, name: str) -> Column:
    """The raw value of a property of unfolded text; null without it."""
    line = rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)"
    return F.when(event.rlike(line), F.regexp_extract(event, line, 1))


def _parameter(event: Column, name: str, parameter: str) -> Column:
    return F.nullif(F.regexp_extract(event, rf'(?m)^{name};[^:\r\n]*?{parameter}="?([^";:\r\n]*)', 1), F.lit(""))


def _text(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(value, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")
    return F.nullif(F.trim(plain), F.lit(""))


def _rule_day(rules: Column, part: str, year: Column) -> Column:
    """When a part (STANDARD or DAYLIGHT) of a zone's yearly rules begins in a year; null without a rule."""
    body = F.regexp_extract(rules, rf"(?s)BEGIN:{part}(.*?)END:{part}", 1)
    month = F.regexp_extract(body, r"BYMONTH=(\d+)", 1).try_cast("int")
    nth = F.regexp_extract(body, r"BYDAY=(-?\d)", 1).try_cast("int")
    day = F.regexp_extract(body, r"BYDAY=-?\d([A-Z]{2})", 1)
    first = F.make_date(year, month, F.lit(1))
    clock = F.regexp_extract(body, r"DTSTART[^:]*:\d{8}T(\d{6})", 1)
    out = None
    for code, name in {"SU": "Sun", "MO": "Mon", "TU": "Tue", "WE": "Wed", "TH": "Thu", "FR": "Fri", "SA": "Sat"}.items():
        date = F.when(nth > 0, F.date_add(F.next_day(F.date_sub(first, 1), name), (nth - 1) * 7)).otherwise(F.date_sub(F.next_day(F.last_day(first), name), 7))
        out = F.when(day == code, date) if out is None else out.when(day == code, date)
    return F.try_to_timestamp(F.concat(F.date_format(out, "yyyyMMdd"), clock), F.lit("yyyyMMddHHmmss"))


def _rule_offset(rules: Column, part: str) -> Column:
    text = F.regexp_extract(rules, rf"(?s)BEGIN:{part}.*?TZOFFSETTO:([+-]\d{{4}})", 1)
    seconds = F.substring(text, 2, 2).try_cast("int") * 3600 + F.substring(text, 4, 2).try_cast("int") * 60
    return F.when(text.startswith("-"), -seconds).otherwise(seconds)


def _custom_instant(local: Column, zones: Column, name: Column) -> Column:
    """A local time of a zone that the feed itself defines, by its yearly rules."""
    one = F.filter(F.regexp_extract_all(zones, F.lit(r"(?s)BEGIN:VTIMEZONE.*?END:VTIMEZONE"), F.lit(0)), lambda z: F.contains(z, F.concat(F.lit("TZID:"), name)))
    rules = F.try_element_at(one, F.lit(1))
    begin, end = (_rule_day(rules, p, F.year(local)) for p in ("DAYLIGHT", "STANDARD"))
    summer = F.when(begin < end, (local >= begin) & (local < end)).otherwise((local >= begin) | (local < end))
    offset = F.when(F.coalesce(summer, F.lit(False)), _rule_offset(rules, "DAYLIGHT")).otherwise(_rule_offset(rules, "STANDARD"))
    return F.timestamp_seconds(F.unix_timestamp(local) - offset)


def _instant(event: Column, name: str, zone: Column, zones: Column) -> Column:
    """A date or time property as an instant: UTC, in its own zone, else local to zone."""
    return let(F.struct(F.trim(prop(event, name)).alias("value"), _parameter(event, name, "TZID").alias("own")), lambda p: _moment(p["value"], p["own"], zone, zones))


def _moment(value: Column, own: Column, zone: Column, zones: Column) -> Column:
    local = F.try_to_timestamp(F.regexp_replace(F.when(F.length(value) == 8, F.concat(value, F.lit("T000000"))).otherwise(value), "[TZ]", ""), F.lit("yyyyMMddHHmmss"))
    known = own.isin(ZONES)
    custom = own.isNotNull() & ~known & F.contains(zones, F.concat(F.lit("TZID:"), own))
    return F.when(value.endswith("Z"), local).when(known, F.to_utc_timestamp(local, F.when(known, own).otherwise(F.lit("UTC")))).when(custom, _custom_instant(local, zones, own)).otherwise(F.to_utc_timestamp(local, zone))


def parse_ics(raw: DataFrame, default_tz: str = "UTC") -> DataFrame:
    """Drafts of read_ics() records, with reason for those that can't be one: no summary or no start.

    All-day and floating times are local to the feed's zone, if it is valid, else to default_tz. An end
    before the start is left out. The organizer is never kept. A recurring event is its first occurrence.
    """
    j = F.from_json("payload", "struct<event: string, zone: string, zones: string>")
    rows = raw.withColumn("_j", j).withColumns({"_e": F.col("_j.event"), "_zones": F.coalesce("_j.zones", F.lit(""))})
    rows = rows.withColumn("_zone", F.when(F.col("_j.zone").isin(ZONES), F.col("_j.zone")).otherwise(F.lit(default_tz)))
    e, zone, zones = F.col("_e"), F.col("_zone"), F.col("_zones")
    rows = rows.withColumns({"_start": _instant(e, "DTSTART", zone, zones), "_until": _instant(e, "DTEND", zone, zones), "_place": _text(prop(e, "LOCATION")), "_about": _text(prop(e, "DESCRIPTION"))})
    end = F.coalesce("_until", F.timestamp_seconds(F.unix_timestamp("_start") + duration_seconds(prop(e, "DURATION"))))
    tzid, utc = _parameter(e, "DTSTART", "TZID"), F.trim(prop(e, "DTSTART")).endswith("Z")
    tz = F.when(~utc & tzid.isin(ZONES), tzid).otherwise(zone)
    at = valid_coordinates(F.split_part(prop(e, "GEO"), F.lit(";"), F.lit(1)), F.split_part(prop(e, "GEO"), F.lit(";"), F.lit(2)))
    place = F.col("_place")
    link = is_url(place)
    mode = F.when(is_meeting_url(place), "online").when(at["lat"].isNotNull() | (place.isNotNull() & ~link), "in_person").otherwise("unknown")
    title = _text(prop(e, "SUMMARY"))
    return rows.select(
        "source_id", "native_id", "content_hash", title.alias("title"), F.left("_about", F.lit(MAX_DESCRIPTION)).alias("description"), F.col("_start").alias("start_utc"), F.when(end >= F.col("_start"), end).alias("end_utc"), tz.alias("tz"),
        F.lit(None).cast("string").alias("venue"), F.when(~link, place).alias("address"), at["lat"].alias("lat"), at["lon"].alias("lon"), mode.alias("attendance_mode"),
        F.when(F.upper(F.trim(prop(e, "STATUS"))) == "CANCELLED", "cancelled").otherwise("scheduled").alias("status"), F.lit(None).cast("string").alias("organizer"),
        F.coalesce(_text(prop(e, "URL")), F.when(link, place), first_url(F.col("_about"))).alias("url"), F.array().cast("array<string>").alias("kinds"), F.lit(None).cast("bigint").alias("size_signal"),
        F.when(title.isNull(), "no summary").when(F.col("_start").isNull(), "no start").alias("reason"))
