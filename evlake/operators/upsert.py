"""Upserting drafts into entities: known links, the same page on the same day, new entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import event_id
from .folds import upsert_fold

#: Columns that follow source precedence.
COLUMNS = ["title", "description", "start_utc", "end_utc", "tz", "venue", "address", "attendance_mode", "organizer", "url", "kinds", "size_signal"]
DEFAULT_PRIORITY = 50


def attach_events(drafts: DataFrame, links: DataFrame, events: DataFrame, now) -> DataFrame:
    """drafts with event_id: of their link, else of a stored event with the same url and UTC start date, else new.

    New drafts of one run with the same url and date are one event, made by the first in order. drafts
    carry source_index and pos, which order them.
    """
    linked = drafts.join(links.select("source_id", "native_id", F.col("event_id").alias("_linked")), ["source_id", "native_id"], "left")
    pages = events.where("url is not null").groupBy("url", F.to_date("start_utc").alias("_day")).agg(F.min("event_id").alias("_paged"))
    paged = linked.withColumn("_day", F.to_date("start_utc")).join(pages, ["url", "_day"], "left")
    page = F.when(F.col("url").isNotNull(), F.struct("url", "_day")).otherwise(F.struct(F.concat_ws(":", "source_id", "native_id").alias("url"), "_day"))
    new = paged.where("_linked is null and _paged is null").groupBy(page.alias("_page")).agg(F.min(F.struct("source_index", "pos")).alias("_at"))
    made = new.select("_page", event_id(F.lit(now).cast("timestamp"), F.col("_at.source_index"), F.col("_at.pos")).alias("_made"))
    found = paged.withColumn("_page", page).join(made, "_page", "left")
    return found.withColumn("event_id", F.coalesce("_linked", "_paged", "_made")).drop("_linked", "_paged", "_made", "_page", "_day")


def upsert(drafts: DataFrame, events: DataFrame, links: DataFrame, sources: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(events, links) after the drafts of a run. sources(source_id, priority) is small configuration."""
    ranked = sources.select("source_id", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"))
    placed = attach_events(drafts, links, events, now)
    new = placed.join(ranked, "source_id", "left").withColumns({
        "priority": F.coalesce("priority", F.lit(DEFAULT_PRIORITY)), "is_stored": F.lit(False), "geo_precision": F.lit(None).cast("string"),
        "ord": (F.col("source_index") + 1) * F.lit(1 << 32) + F.col("pos"),
    })
    touched = events.join(new.select("event_id").distinct(), "event_id", "left_semi")
    old = touched.join(ranked.withColumnRenamed("source_id", "primary_source"), "primary_source", "left").withColumns({
        "source_id": F.col("primary_source"), "priority": F.coalesce("priority", F.lit(DEFAULT_PRIORITY)), "is_stored": F.lit(True), "ord": F.lit(0).cast("bigint"),
    })
    shared = ["event_id", "source_id", "priority", "is_stored", "ord", "status", "lat", "lon", "geo_precision", *COLUMNS]
    folded = upsert_fold(old.select(*shared).unionByName(new.select(*shared)), "event_id", "ord", "source_id", "priority", COLUMNS)
    times = folded.join(events.select("event_id", "first_seen", "rule_kinds"), "event_id", "left").withColumns({
        "first_seen": F.coalesce("first_seen", F.lit(now).cast("timestamp")), "last_seen": F.lit(now).cast("timestamp"), "rule_kinds": F.coalesce("rule_kinds", F.array().cast("array<string>")),
    })
    rest = events.join(new.select("event_id").distinct(), "event_id", "left_anti")
    now_linked = placed.select("source_id", "native_id", "event_id", "url", "content_hash")
    kept = links.join(now_linked, ["source_id", "native_id"], "left_anti")
    return rest.unionByName(times.select(*rest.columns)), kept.unionByName(now_linked)
