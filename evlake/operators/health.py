"""Source health: trailing yields, verdicts, streaks of unhealthy runs, alerts and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros

# Default service levels.
MIN_YIELD_RATIO, WINDOW_DAYS, MIN_HISTORY_RUNS = 0.5, 14, 5
MAX_PARSE_ERROR_RATIO, ALERT_AFTER, DISABLE_AFTER = 0.2, 2, 7
PROBE_DAYS = 7
_DAY = 86_400_000_000


def with_baseline(runs: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """runs with typical (median fetched) and n_history over a source's earlier ok runs within window_days."""
    frame = Window.partitionBy("source_id").orderBy(micros(F.col("started_at"))).rangeBetween(-window_days * _DAY, -1)
    fetched = F.when(F.col("status") == "ok", F.col("fetched"))
    return runs.withColumns({"typical": F.percentile(fetched, F.lit(0.5)).over(frame), "n_history": F.count(fetched).over(frame)})


def verdicts(runs: DataFrame, min_yield: float = MIN_YIELD_RATIO, window_days: int = WINDOW_DAYS, min_history: int = MIN_HISTORY_RUNS, max_errors: float = MAX_PARSE_ERROR_RATIO) -> DataFrame:
    """runs with reasons (array) and healthy; disabled runs are left out."""
    based = with_baseline(runs.where("status <> 'disabled'"), window_days)
    attempted = F.col("parsed") + F.col("parse_errors")
    failed = F.when(F.col("status") != "ok", F.concat(F.lit("fetch failed: "), F.coalesce("error", "status")))
    broken = F.when(F.try_divide(F.col("parse_errors"), attempted) > max_errors, F.concat(F.col("parse_errors"), F.lit(" of "), attempted, F.lit(" changed records failed to parse")))
    low = (F.col("status") == "ok") & (F.col("n_history") >= min_history) & (F.col("typical") > 0) & (F.col("fetched") < min_yield * F.col("typical"))
    shown = F.regexp_replace(F.col("typical").cast("string"), r"\.0$", "")
    few = F.when(low, F.concat(F.lit("fetched "), F.col("fetched"), F.lit(" records, typical is "), shown))
    return based.withColumn("reasons", F.array_compact(F.array(failed, broken, few))).withColumn("healthy", F.size("reasons") == 0)


def states(judged: DataFrame, alert_after: int = ALERT_AFTER, disable_after: int = DISABLE_AFTER) -> DataFrame:
    """judged runs with the state after each: unhealthy_runs in a row, since, state, and action (alert or resolve).

    An alert is raised when a streak reaches alert_after and again when a source becomes disabled; it is
    resolved by the first healthy run after it.
    """
    order = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    island = judged.withColumn("_island", F.sum(F.col("healthy").cast("int")).over(order))
    streak = Window.partitionBy("source_id", "_island").orderBy("started_at", "run_id")
    bad = (~F.col("healthy")).cast("int")
    n = F.sum(bad).over(streak)
    since = F.min(F.when(~F.col("healthy"), F.col("started_at"))).over(streak)
    counted = island.withColumns({"unhealthy_runs": n, "since": F.when(~F.col("healthy"), since)})
    state = F.when(F.col("healthy"), "healthy").when(F.col("unhealthy_runs") >= disable_after, "disabled").otherwise("unhealthy")
    before = F.coalesce(F.lag("unhealthy_runs").over(order), F.lit(0))
    alert = ~F.col("healthy") & ((F.col("unhealthy_runs") == alert_after) | (F.col("unhealthy_runs") == disable_after))
    action = F.when(alert, "alert").when(F.col("healthy") & (before >= min(alert_after, disable_after)), "resolve")
    return counted.withColumn("state", state).withColumn("action", action).drop("_island")


def probe_due(state: Column, last_probe: Column, since: Column, now: Column) -> Column:
    """Whether a source is fetched: always, unless disabled and probed less than a week ago."""
    last = F.coalesce(last_probe, since)
    return (state != "disabled") | last.isNull() | (last <= now - F.make_dt_interval(F.lit(PROBE_DAYS)))


def select_sources(sources: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """sources with fetch (boolean); those skipped get a run row of status disabled."""
    joined = sources.join(state, "source_id", "left")
    return joined.withColumn("fetch", probe_due(F.coalesce("state", F.lit("healthy")), F.col("last_probe"), F.col("since"), now))


def source_states(runs: DataFrame, **levels: float) -> DataFrame:
    """(source_id, state, since, last_probe): where each source of a log of runs stands; last_probe is its last run that fetched."""
    judged = states(verdicts(runs, **levels)).groupBy("source_id").agg(F.max_by(F.struct("state", "since"), F.struct("started_at", "run_id")).alias("_s"), F.max("started_at").alias("last_probe"))
    return judged.select("source_id", "_s.state", "_s.since", "last_probe")


def skipped_runs(selected: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Run rows of the sources that select_sources() leaves out."""
    none = [F.lit(0).cast("bigint").alias(c) for c in ("fetched", "changed", "parsed", "parse_errors")]
    return selected.where(~F.col("fetch")).select("source_id", *none, F.lit("disabled").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(run_id).alias("run_id"), now.alias("started_at"))


def alerts(judged: DataFrame) -> DataFrame:
    """(source_id, run_id, action, title, body) of judged runs that raise or resolve an alert."""
    title = F.concat(F.lit("Source "), "source_id", F.when(F.col("action") == "resolve", F.lit(" recovered")).otherwise(F.concat(F.lit(" is "), "state")))
    body = F.when(F.col("action") == "alert", F.concat_ws("\n", F.concat(F.lit("Unhealthy runs in a row: "), "unhealthy_runs"), F.array_join("reasons", "\n"))).otherwise(F.lit("Healthy again."))
    return judged.where("action is not null").select("source_id", "run_id", "action", title.alias("title"), body.alias("body"))


def drift_samples(unhealthy: DataFrame, raw: DataFrame, n: int = 10) -> DataFrame:
    """For each unhealthy (source_id, run_id): its reasons and the first n raw records by native id; none if it fetched none."""
    found = unhealthy.select("source_id", "run_id", "reasons").join(raw, ["source_id", "run_id"], "left")
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("source_id", "run_id").orderBy("native_id"))).where(F.col("_k") <= n)
    return first.groupBy("source_id", "run_id", "reasons").agg(F.array_sort(F.collect_list(F.when(F.col("native_id").isNotNull(), F.struct("native_id", "payload")))).alias("records"))
