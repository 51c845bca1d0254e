"""Instants, zones and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

HOME_ZONE = "America/Los_Angeles"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"


def micros(instant: Column) -> Column:
    """Microseconds since 1970, of timestamps with and without a zone."""
    return F.unix_micros(instant.cast("timestamp"))


def parse_iso(value: Column, zone: Column) -> Column:
    """An instant: a date is midnight in zone, a time without an offset is local to zone; null if it can't be read."""
    value = F.trim(value)
    local = F.try_to_timestamp(F.regexp_replace(value, "T", " "))
    return F.when(F.length(value) == 10, F.to_utc_timestamp(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), zone)).when(value.rlike(_OFFSET), F.try_to_timestamp(value)).otherwise(F.to_utc_timestamp(local, zone))


def offset_minutes(value: Column) -> Column:
    """Minutes east of UTC that a time's text states; null if none."""
    sign = F.when(F.regexp_extract(value, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    hours, minutes = (F.regexp_extract(value, r"[+-](\d{2}):?(\d{2})$", i).try_cast("int") for i in (1, 2))
    return F.when(value.endswith("Z"), F.lit(0)).otherwise(sign * (hours * 60 + minutes))


def zone_for_offset(value: Column, zone: Column) -> Column:
    """zone, if a published time's offset is the zone's own at that time."""
    instant = F.try_to_timestamp(value)
    own = (F.unix_timestamp(F.from_utc_timestamp(instant, zone)) - F.unix_timestamp(instant)) / 60
    return F.when(own == offset_minutes(value), zone)


def db_text(instant: Column) -> Column:
    """ISO text in UTC with microseconds, which sorts as the instant does."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def from_db_text(text: Column) -> Column:
    return F.try_to_timestamp(text)


def dates_only(value: Column, zone: Column) -> Column:
    """The local midnight of a time's date part."""
    return parse_iso(F.left(F.trim(value), F.lit(10)), zone)


def local_time(instant: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(instant, F.coalesce(zone, F.lit(HOME_ZONE)))


def local_day(instant: Column, zone: Column) -> Column:
    return F.to_date(local_time(instant, zone))


def day_heading(instant: Column, zone: Column) -> Column:
    return F.date_format(local_time(instant, zone), "EEEE, MMMM d, yyyy")


def all_day(start: Column, end: Column, zone: Column) -> Column:
    """Local midnight and no end."""
    return end.isNull() & (F.date_format(local_time(start, zone), "HH:mm:ss") == "00:00:00")


def spans_days(start: Column, end: Column, zone: Column) -> Column:
    return F.coalesce(local_day(start, zone) != local_day(end, zone), F.lit(False))


def time_range(start: Column, end: Column, zone: Column) -> Column:
    """What a page shows for the time of day."""
    first = F.date_format(local_time(start, zone), "h:mm a")
    last = F.when(spans_days(start, end, zone), F.date_format(local_time(end, zone), "MMM d, h:mm a")).otherwise(F.date_format(local_time(end, zone), "h:mm a"))
    return F.when(all_day(start, end, zone), F.lit("All day")).when(end.isNull(), first).otherwise(F.concat(first, F.lit(" – "), last))


def when_label(start: Column, end: Column, zone: Column) -> Column:
    return F.concat(F.date_format(local_time(start, zone), "EEE, MMM d"), F.lit(", "), time_range(start, end, zone))


def zone_abbreviation(instant: Column, zone: Column) -> Column:
    """Short zone names of the United States, by whether summer time holds; else the offset."""
    zone = F.coalesce(zone, F.lit(HOME_ZONE))
    offset = (F.unix_timestamp(F.from_utc_timestamp(instant, zone)) - F.unix_timestamp(instant)) / 60
    # Standard offset in minutes and names.
    known = {"America/Los_Angeles": (-480, "PST", "PDT"), "America/Denver": (-420, "MST", "MDT"), "America/Chicago": (-360, "CST", "CDT"), "America/New_York": (-300, "EST", "EDT")}
    out = F.when(zone == "UTC", F.lit("UTC"))
    for name, (standard, winter, summer) in known.items():
        out = out.when(zone == name, F.when(offset == standard, F.lit(winter)).otherwise(F.lit(summer)))
    return out.otherwise(F.format_string("UTC%+d", (offset / 60).cast("int")))


def rss_when(instant: Column, zone: Column) -> Column:
    return F.concat_ws(" ", F.date_format(local_time(instant, zone), "EEE, MMM d yyyy, h:mm a"), zone_abbreviation(instant, zone))


def season_of(day: Column) -> Column:
    """The year in which the season of a day ends; seasons begin in July."""
    return F.year(F.add_months(day, 6))


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO duration such as P1DT2H30M or P2W; null if it isn't one."""

    def seconds(text: Column) -> Column:
        # a part that isn't there is no failed cast, which costs far more
        value = lambda digits: let(digits, lambda d: F.when(d != "", F.coalesce(d.try_cast("bigint"), F.lit(0))).otherwise(0))
        time = F.regexp_extract(text, r"T(.*)$", 1)
        of_time = lambda unit: value(F.regexp_extract(time, rf"(\d+){unit}", 1))
        return value(F.regexp_extract(text, r"(\d+)W", 1)) * 604800 + value(F.regexp_extract(text, r"^[+-]?P[^T]*?(\d+)D", 1)) * 86400 + of_time("H") * 3600 + of_time("M") * 60 + of_time("S")

    return let(text, lambda t: F.when(t.rlike(r"^\+?P"), seconds(t)).when(t.rlike(r"^-P"), -seconds(t)))
