"""Feeds of a profile's events, and the version that commits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import db_text, rss_when
from . import versions
from .storage import discard, written

SCHEMA_VERSION = 1
RSS_ITEMS = 100
NEW_DAYS = 7


def is_upcoming(now: Column) -> Column:
    return F.coalesce("end_utc", "start_utc") >= now


def added_between(members: DataFrame, start: Column, end: Column, now: Column) -> DataFrame:
    """Members that joined in [start, end), haven't begun and aren't cancelled."""
    return members.where((F.col("first_seen") >= start) & (F.col("first_seen") < end) & (F.col("start_utc") > now) & (F.col("status") != "cancelled"))


def is_new(first_seen: Column, now: Column) -> Column:
    return first_seen >= now - F.make_dt_interval(F.lit(NEW_DAYS))


def with_sources(events: DataFrame, links: DataFrame) -> DataFrame:
    """events with sources, an array of (source_id, native_id, url) in order; one source counts once in source_ids."""
    nested = links.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "native_id", "url"))).alias("sources"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return events.join(nested, "event_id", "left")


def profile_events(events: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Upcoming events of each profile, with when they joined it."""
    return events.where(is_upcoming(now)).drop("first_seen").join(members.select("event_id", "profile_id", "first_seen"), "event_id")


def feed_counts(feed: DataFrame, now: Column) -> DataFrame:
    return feed.groupBy("profile_id").agg(F.count("*").alias("upcoming"), F.count_if(is_new(F.col("first_seen"), now)).alias("new"))


def newest(feed: DataFrame, n: int = RSS_ITEMS) -> DataFrame:
    """The n newest of each profile; Spark drops the rest before the shuffle."""
    order = Window.partitionBy("profile_id").orderBy(F.desc("first_seen"), F.desc("event_id"))
    return feed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def framed(items: DataFrame, frames: DataFrame, order: list[str], separator: str = "") -> DataFrame:
    """(profile_id, value): the lines of each profile's document: head, items in order, foot.

    items(profile_id, value, order columns), frames(profile_id, head, foot). Items but a profile's first
    begin with separator. Range partitions are in document order, so part files put one after the other
    are the document, and no profile lies in one cell or task.
    """
    at = F.struct(*order)
    first = items.groupBy("profile_id").agg(F.min(at).alias("_first"))
    placed = items.withColumn("_at", at)
    if separator:
        placed = placed.join(F.broadcast(first), "profile_id").withColumn("value", F.when(F.col("_at") == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(separator), "value")))
    ends = frames.select("profile_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("head").alias("value")), F.struct(F.lit(2).alias("part"), F.col("foot").alias("value")))).alias("e")).select("profile_id", "e.part", "e.value")
    body = placed.select("profile_id", F.lit(1).alias("part"), "value", "_at")
    lines = body.unionByName(ends, allowMissingColumns=True)
    keys = ["profile_id", "part", "_at"]
    return lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("profile_id", "value")


def named_profiles(feed: DataFrame, names: DataFrame | None) -> DataFrame:
    """(profile_id, name): those of names, which may have no event; without names those of the feed, under their ids."""
    return feed.select("profile_id").distinct().withColumn("name", F.col("profile_id")) if names is None else names.select("profile_id", "name")


def json_lines(feed: DataFrame) -> DataFrame:
    """One JSON text for each event, keys in order."""
    return feed.select("profile_id", "start_utc", "event_id", F.to_json(F.struct(*sorted(c for c in feed.columns if c != "profile_id"))).alias("value"))


def json_document(feed: DataFrame, generated: Column, names: DataFrame | None = None) -> DataFrame:
    """(profile_id, value): lines of each profile's JSON document: count, events in feed order, generated_at, profile, schema_version."""
    counts = feed.groupBy("profile_id").agg(F.count("*").alias("n"))
    frames = named_profiles(feed, names).join(counts, "profile_id", "left").select(
        "profile_id", F.concat(F.lit('{"count":'), F.coalesce("n", F.lit(0)), F.lit(',"events":[')).alias("head"),
        F.concat(F.lit('],"generated_at":"'), db_text(generated), F.lit('","profile":'), F.to_json(F.struct(F.col("profile_id").alias("id"), "name")), F.lit(f',"schema_version":{SCHEMA_VERSION}}}')).alias("foot"))
    return framed(json_lines(feed), frames, ["start_utc", "event_id"], ",")


def _write(lines: DataFrame, path: str, line_end: str = "\n") -> None:
    lines.write.mode("overwrite").partitionBy("profile_id").text(path, lineSep=line_end)


def write_json_feed(feed: DataFrame, path: str, generated: Column, names: DataFrame | None = None) -> None:
    _write(json_document(feed, generated, names), path)


def _ics_text(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"([\\,;])", r"\\$1"), r"\r?\n", r"\\n")


def fold_line(line: Column) -> Column:
    """A content line in pieces of 74 octets at most, so that none exceeds the format's 75 with its space; no character is cut."""

    def step(acc: Column, c: Column) -> Column:
        wide = acc["octets"] + F.octet_length(c)
        return F.when(wide > 74, F.struct(F.concat(acc["text"], F.lit("\r\n "), c).alias("text"), F.octet_length(c).alias("octets"))).otherwise(F.struct(F.concat(acc["text"], c).alias("text"), wide.alias("octets")))

    by_octets = F.aggregate(F.split(line, ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("octets")), step)["text"]
    return F.when(F.octet_length(line) == F.length(line), F.regexp_replace(line, r"(?s)(.{74})(?=.)", "$1\r\n ")).otherwise(by_octets)


def ics_event(generated: Column) -> Column:
    """The calendar text of an event row."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    where = F.nullif(F.concat_ws(", ", "venue", "address"), F.lit(""))
    about = F.nullif(F.concat_ws("\n\n", F.left("description", F.lit(1000)), "url"), F.lit(""))
    line = lambda name, v: F.when(v.isNotNull(), fold_line(F.concat(F.lit(name + ":"), v)))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), line("UID", F.col("event_id")), line("DTSTAMP", stamp(generated)), line("DTSTART", stamp("start_utc")), line("DTEND", stamp("end_utc")),
        line("SUMMARY", _ics_text(F.col("title"))), line("LOCATION", _ics_text(where)), line("GEO", F.when(F.col("lat").isNotNull(), F.concat_ws(";", "lat", "lon"))), line("URL", F.col("url")),
        line("DESCRIPTION", _ics_text(about)), line("STATUS", F.when(F.col("status") == "cancelled", F.lit("CANCELLED")).otherwise("CONFIRMED")),
        line("CATEGORIES", F.nullif(F.array_join(F.array_sort("kinds"), ","), F.lit(""))), F.lit("END:VEVENT"))
    return F.array_join(F.array_compact(lines), "\r\n")


def ics_document(feed: DataFrame, generated: Column, names: DataFrame | None = None) -> DataFrame:
    """(profile_id, value): lines of each profile's calendar."""
    head = ["BEGIN:VCALENDAR", "PRODID:-//evlake//EN", "VERSION:2.0", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "X-WR-CALNAME:{}", "X-PUBLISHED-TTL:PT12H"]
    named = fold_line(F.concat(F.lit("X-WR-CALNAME:"), _ics_text(F.col("name"))))
    lines = [named if "{}" in h else F.lit(h) for h in head]
    frames = named_profiles(feed, names).select("profile_id", F.concat_ws("\r\n", *lines).alias("head"), F.lit("END:VCALENDAR").alias("foot"))
    items = feed.withColumn("value", ics_event(generated)).select("profile_id", "start_utc", "event_id", "value")
    return framed(items, frames, ["start_utc", "event_id"])


def write_ics_feed(feed: DataFrame, path: str, generated: Column, names: DataFrame | None = None) -> None:
    _write(ics_document(feed, generated, names), path, "\r\n")


def _xml(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def rss_item() -> Column:
    """The feed item of an event row."""
    place = F.nullif(F.concat_ws(", ", "venue", "address"), F.lit(""))
    about = F.concat_ws("\n", F.when(F.col("status") == "cancelled", F.lit("CANCELLED")), rss_when(F.col("start_utc"), F.col("tz")), place, F.left("description", F.lit(500)))
    tag = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"<{name}>"), _xml(v), F.lit(f"</{name}>")))
    kinds = F.array_join(F.transform(F.array_sort("kinds"), lambda k: F.concat(F.lit("<category>"), _xml(k), F.lit("</category>"))), "")
    published = F.concat(F.date_format("first_seen", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return F.concat(F.lit("<item>"), F.concat_ws("", tag("title", F.col("title")), tag("link", F.col("url")), F.concat(F.lit('<guid isPermaLink="false">'), _xml(F.col("event_id")), F.lit("</guid>")), tag("pubDate", published), tag("description", about), kinds), F.lit("</item>"))


def rss_document(feed: DataFrame, generated: Column, names: DataFrame | None = None, site: str = "") -> DataFrame:
    """(profile_id, value): lines of each profile's channel with its newest events."""
    name = _xml(F.col("name"))
    built = F.concat(F.date_format(generated, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>'), name, F.lit("</title><link>"), _xml(F.lit(site)), F.lit("</link><description>New events: "), name,
        F.lit("</description><lastBuildDate>"), built, F.lit("</lastBuildDate>"))
    frames = named_profiles(feed, names).select("profile_id", head.alias("head"), F.lit("</channel></rss>").alias("foot"))
    return framed(newest(feed).withColumn("value", rss_item()).select("profile_id", "place", "value"), frames, ["place"])


def write_rss_feed(feed: DataFrame, path: str, generated: Column, names: DataFrame | None = None, site: str = "") -> None:
    _write(rss_document(feed, generated, names, site), path)


def manifest(counts: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """(profile_id, value): counts and each source's figures, without error texts."""
    columns = ["source_id", "status", "fetched", "changed", "parsed", "parse_errors"]
    # one array of a row for each configured source
    listed = runs.groupBy(F.lit(run_id).alias("run_id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("sources"))
    joined = counts.withColumn("run_id", F.lit(run_id)).join(F.broadcast(listed), "run_id", "left")
    return joined.select("profile_id", F.to_json(F.struct(F.struct("new", "upcoming").alias("counts"), "run_id", F.lit(SCHEMA_VERSION).alias("schema_version"), "sources")).alias("value"))


def publish(feed: DataFrame, runs: DataFrame, run_id: str, path: str, now: Column, names: DataFrame | None = None, site: str = "") -> bool:
    """Writes all feeds and the day's additions to a folder of the run's own and then commits it; nothing if every active source failed.

    Readers take the folder from published(), which names the run before until all of this one is
    written, whatever is written or lost meanwhile. The feed is worked out once. names(profile_id, name)
    are the profiles, also those without an event; without it those of the feed.
    """
    active, failed = runs.agg(F.count_if(F.col("status") != "disabled"), F.count_if(~F.col("status").isin("ok", "disabled"))).first()
    if active and active == failed:
        return False
    spark = runs.sparkSession
    number, before = versions.current(spark, path)
    folder = f"{path}/run-{number + 1:06d}"  # a run that broke off used the same one, and is overwritten
    feed = written(feed, "feed")
    write_json_feed(feed, f"{folder}/json", now, names)
    day = F.date_trunc("day", now)
    write_json_feed(added_between(feed, day, day + F.make_dt_interval(F.lit(1)), now), f"{folder}/new", now, named_profiles(feed, names))
    write_ics_feed(feed, f"{folder}/ics", now, names)
    write_rss_feed(feed, f"{folder}/rss", now, names, site)
    counted = named_profiles(feed, names).select("profile_id").join(feed_counts(feed, now), "profile_id", "left").na.fill(0, ["upcoming", "new"])
    _write(manifest(counted, runs, run_id), f"{folder}/manifest")
    versions.commit(spark, path, number, {"run_id": run_id, "folder": folder, "before": before.get("folder")})
    if before.get("before"):  # who reads the run before still finds it
        discard(spark, before["before"])
    return True


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the last run that was published whole; None if there is none."""
    return versions.current(spark, path)[1].get("folder")


def _fields(schema: T.DataType, path: str = "") -> list[tuple[str, str, bool]]:
    out = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            name = f"{path}.{f.name}" if path else f.name
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            kind = f.dataType.typeName() if isinstance(inner, T.StructType) else f.dataType.simpleString()
            out += [(name, kind, f.nullable), *_fields(inner, name)]
    return out


def schema_diff(frozen: T.StructType, current: T.StructType) -> list[tuple[str, str]]:
    """(field, problem) for every field that readers of frozen would miss: removed, of another type, or no longer required. Additions are fine."""
    now = {name: (kind, nullable) for name, kind, nullable in _fields(current)}
    out = []
    for name, kind, nullable in _fields(frozen):
        if name not in now:
            out.append((name, "removed"))
        elif now[name][0] != kind:
            out.append((name, f"{kind} became {now[name][0]}"))
        elif now[name][1] and not nullable:
            out.append((name, "no longer required"))
    return out
