"""Merging rows of one entity by source precedence, in closed form: one window and one aggregation on the same key.

Rows of a key are read in order. A row leads if there is no leader yet, if it is of the leading source,
or if its priority is strictly higher than the leader's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import location_rank


def with_leaders(rows: DataFrame, key: str, order: str, source: str, priority: str, same_source: bool = True) -> DataFrame:
    """rows with leads (boolean), by the highest priority before each row, the earliest of equals."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.when(F.col(source).isNotNull(), F.struct(F.col(priority).alias("p"), (-F.col(order)).alias("o"), F.col(source).alias("s")))).over(before)
    higher = F.col(priority) > F.col("_top.p")
    again = (F.col(source) == F.col("_top.s")) if same_source else F.lit(False)
    return rows.withColumn("_top", top).withColumn("leads", F.coalesce(F.col("_top").isNull() | again | higher, F.lit(False))).drop("_top")


def _last(column: str, order: str, when: Column) -> Column:
    return F.max_by(column, F.when(when & F.col(column).isNotNull(), F.col(order)))


def _first(column: str, order: str, when: Column) -> Column:
    return F.min_by(column, F.when(when & F.col(column).isNotNull(), F.col(order)))


def precedence(column: str, order: str) -> Column:
    """The last value of a leader, else the first value of any row."""
    return F.coalesce(_last(column, order, F.col("leads")), _first(column, order, F.lit(True))).alias(column)


def upsert_fold(rows: DataFrame, key: str, order: str, source: str, priority: str, columns: list[str]) -> DataFrame:
    """One row for each key from its stored row (is_stored, the least in order) and new drafts.

    columns follow precedence(); an empty kinds array counts as null. status is the last leader's,
    unless a later row that doesn't lead says cancelled. A draft's point replaces the stored one if it
    leads or the stored one is no exact point, and then has no precision.
    """
    led = with_leaders(rows, key, order, source, priority)
    if "kinds" in columns:
        led = led.withColumn("kinds", F.when(F.size("kinds") > 0, F.col("kinds")))
    draft = ~F.col("is_stored") & F.col("lat").isNotNull()
    point = F.struct("lat", "lon", "geo_precision")
    plain = F.struct("lat", "lon", F.lit(None).cast("string").alias("geo_precision"))
    at = F.col(order)
    folded = led.groupBy(key).agg(
        *[precedence(c, order) for c in columns],
        F.max(F.when(F.col("leads"), at)).alias("_lead"),
        F.max(F.when(~F.col("leads") & (F.col("status") == "cancelled"), at)).alias("_cancel"),
        _last("status", order, F.col("leads")).alias("_status"),
        F.max_by(plain, F.when(draft & F.col("leads"), at)).alias("_leading"),
        F.max_by(point, F.when(F.col("is_stored") & F.col("lat").isNotNull() & ~F.coalesce(F.col("geo_precision").isin("postal", "place"), F.lit(False)), at)).alias("_exact"),
        F.min_by(plain, F.when(draft, at)).alias("_any"),
        F.max_by(point, F.when(F.col("is_stored") & F.col("lat").isNotNull(), at)).alias("_centroid"),
        F.max_by(source, F.when(F.col("leads"), at)).alias("primary_source"),
    )
    status = F.when(F.col("_cancel") > F.col("_lead"), "cancelled").otherwise(F.col("_status"))
    placed = folded.withColumn("status", status).withColumn("_at", F.coalesce("_leading", "_exact", "_any", "_centroid"))
    return placed.select(key, *columns, "status", "_at.lat", "_at.lon", "_at.geo_precision", "primary_source")


def merge_fold(members: DataFrame, key: str, order: str, source: str, priority: str, columns: list[str]) -> DataFrame:
    """One row for each group of duplicates, the survivor first in order.

    A loser leads only by a strictly higher priority. status is cancelled if any member is, else the
    survivor's; the location is that of the best location_rank(), of equals the last leader's, else the
    first; first_seen is the least and last_seen the greatest; kinds and rule_kinds stay the survivor's.
    """
    led = with_leaders(members, key, order, source, priority, same_source=False).withColumn("_rank", location_rank(F.col("lat"), F.col("geo_precision")))
    at = F.col(order)
    # of the best rank, leaders count by place from the end and others, after them, from the beginning
    best = F.min_by(F.struct("lat", "lon", "geo_precision"), F.struct("_rank", F.when(F.col("leads"), 0).otherwise(1).alias("k"), F.when(F.col("leads"), -at).otherwise(at).alias("o")))
    kept = [c for c in ("kinds", "rule_kinds") if c in members.columns]
    folded = led.groupBy(key).agg(
        *[precedence(c, order) for c in columns], *[F.min_by(c, at).alias(c) for c in kept],
        F.when(F.max(F.col("status") == "cancelled"), "cancelled").otherwise(F.min_by("status", at)).alias("status"),
        best.alias("_at"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return folded.select(key, *columns, *kept, "status", "_at.lat", "_at.lon", "_at.geo_precision", "first_seen", "last_seen")


def resolve_aliases(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """aliases(alias_id, event_id, merged_at) after merges(loser, survivor, merged_at): still one step deep."""
    moved = aliases.join(merges.select(F.col("loser").alias("event_id"), "survivor"), "event_id", "left").select("alias_id", F.coalesce("survivor", "event_id").alias("event_id"), "merged_at")
    return moved.unionByName(merges.select(F.col("loser").alias("alias_id"), F.col("survivor").alias("event_id"), "merged_at"))
