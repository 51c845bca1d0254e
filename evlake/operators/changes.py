"""Change data: latest versions, what is new or changed, pruning, validation, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["conference", "hackathon", "meetup", "talk", "workshop"]
MODES = ["in_person", "online", "hybrid", "unknown"]
STATUSES = ["scheduled", "cancelled", "postponed"]


def latest_versions(raw: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key; combined before the shuffle. Of equal times the greatest row by its other columns."""
    rest = [c for c in raw.columns if c not in keys]
    newest = raw.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_hashes(raw: DataFrame, keys: list[str], at: str, digest: str = "content_hash") -> DataFrame:
    """(keys, at, digest) of the newest row of each key; payloads aren't read. Of equal times the greater digest counts."""
    newest = raw.groupBy(*keys).agg(F.max(F.struct(at, digest)).alias("_n"))
    return newest.select(*keys, f"_n.{at}", f"_n.{digest}")


def prune(raw: DataFrame, keys: list[str], at: str, cutoff: Column) -> DataFrame:
    """Rows at or after the cutoff, and each key's latest whatever its age."""
    last = F.max(at).over(Window.partitionBy(*keys))
    return raw.withColumn("_last", last).where((F.col(at) >= cutoff) | (F.col(at) == F.col("_last"))).drop("_last")


def detect_changes(incoming: DataFrame, latest: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """incoming with change: new, changed (a return to older content too) or unchanged."""
    known = latest.select(*keys, F.col(digest).alias("_known"), F.lit(True).alias("_seen"))
    change = F.when(F.col("_seen").isNull(), "new").when(F.col(digest).eqNullSafe(F.col("_known")), "unchanged").otherwise("changed")
    return incoming.join(known, keys, "left").withColumn("change", change).drop("_known", "_seen")


def append_raw(changed: DataFrame, path: str, run_id: str) -> None:
    """Appends to the raw log; content that comes back is appended again, and so becomes the latest. A run that is tried again replaces its own records."""
    changed.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "run_id").parquet(path)


def draft_reasons() -> Column:
    """Everything that is wrong with a draft row, as sorted text."""
    lat, lon = F.col("lat"), F.col("lon")
    checks = {
        "blank title": F.coalesce(F.trim("title") == "", F.lit(True)),
        "no start": F.col("start_utc").isNull(),
        "end before start": F.col("end_utc") < F.col("start_utc"),
        "half a location": lat.isNull() != lon.isNull(),
        "location out of range": ~lat.between(-90, 90) | ~lon.between(-180, 180),
        "negative size": F.col("size_signal") < 0,
        "unknown mode": ~F.col("attendance_mode").isin(MODES),
        "unknown status": ~F.col("status").isin(STATUSES),
        "unknown kind": F.exists("kinds", lambda k: ~k.isin(KINDS)),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in sorted(checks.items())]))


def validate(rows: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): rejects carry reasons; reasons are worked out once a row."""
    judged = rows.withColumn("reasons", reasons)
    return judged.where("size(reasons) = 0").drop("reasons"), judged.where("size(reasons) > 0")


def reject_counts(rejects: DataFrame, sample: str | None = None) -> DataFrame:
    """How often each reason occurs, with up to five examples of a column, the least ones."""
    exploded = rejects.withColumn("reason", F.explode("reasons"))
    counts = exploded.groupBy("reason").agg(F.count("*").alias("n"))
    if not sample:
        return counts
    ranked = exploded.select("reason", sample).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("reason").orderBy(sample))).where("_k <= 5")
    return counts.join(ranked.groupBy("reason").agg(F.array_sort(F.collect_list(sample)).alias("examples")), "reason")


def run_metrics(active: DataFrame, records: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each active source: fetched, changed, parsed, parse_errors, status, error.

    records(source_id, change, parsed, parse_error) are this run's records; errors(source_id, error)
    are sources that failed as a whole.
    """
    counts = records.groupBy("source_id").agg(F.count("*").alias("fetched"), F.count_if(F.col("change") != "unchanged").alias("changed"), F.count_if("parsed").alias("parsed"), F.count_if("parse_error").alias("parse_errors"))
    joined = active.join(counts, "source_id", "left").join(errors, "source_id", "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("fetched", "changed", "parsed", "parse_errors")]
    return joined.select("source_id", *filled, F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")


def run_status(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """failed if no active source was ok, degraded if some weren't, else ok; disabled sources don't count."""
    active, bad = F.count_if(F.col("status") != "disabled"), F.count_if(~F.col("status").isin("ok", "disabled"))
    status = F.when((active > 0) & (bad == active), "failed").when(bad > 0, "degraded").otherwise("ok")
    return runs.groupBy(*(by or [])).agg(status.alias("run_status"))


def fetch_outcome(status: Column, headers: Column, method: Column) -> Column:
    """retry, error, challenge or ok, for a row of a fetch log."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    challenge = F.array_contains(names, "cf-mitigated") | F.array_contains(names, "x-amzn-waf-action") | ((method == "GET") & (status == 202))
    return F.when(challenge, "challenge").when(status.isin(429, 500, 502, 503, 504), "retry").when(status >= 400, "error").otherwise("ok")
