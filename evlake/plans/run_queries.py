"""Queries on the daily run and its streaming forms: rows of the driver's tables go through them as feeds and as streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify
from ..operators.storage import shared_dir, spread, written_at
from ..sources import geojson, ics
from ..streaming import jobs
from . import run as daily
from .registry import query, table
from .store import Store
from .view_queries import _VERDICTS, _runs, _verdicts

NOW = dt.datetime(2026, 10, 1)
EVENT = "event_id string, title string, description string, start_utc timestamp, end_utc timestamp, tz string, venue string, address string, lat double, lon double, attendance_mode string, status string, organizer string, url string, kinds array<string>, size_signal bigint, rule_kinds array<string>, geo_precision string, primary_source string, first_seen timestamp, last_seen timestamp"
BOX = '{"type":"Feature","properties":{"name":"Box"},"geometry":{"type":"Polygon","coordinates":[[[-119,33],[-117,33],[-117,35],[-119,35]]]}}'
TOPIC = classify.Topic(["gathering"], ["household"])


def _empty(spark: SparkSession) -> daily.State:
    none = lambda schema: spark.createDataFrame([], schema)
    return daily.State(
        none(EVENT), none("source_id string, native_id string, event_id string, url string, content_hash string"), none("source_id string, native_id string, content_hash string, payload string, fetched_at timestamp, run_id string"),
        none("source_id string, run_id string, started_at timestamp, status string, fetched long, changed long, parsed long, parse_errors long, error string"), none("event_id string, profile_id string, first_seen timestamp"), none("alias_id string, event_id string, merged_at timestamp"))


def _reference(spark: SparkSession) -> daily.Reference:
    none = lambda schema: spark.createDataFrame([], schema)
    sources = [(f"cal-{k}", "ics", True, 50 + k, ["meetup"] if k else [], "box" if k == 2 else None) for k in range(4)]
    return daily.Reference(
        spark.createDataFrame(sources, "source_id string, adapter string, enabled boolean, priority int, default_kinds array<string>, keep_region string"), geojson.polygons(spark.createDataFrame([("box", BOX)], "region_id string, body string")),
        none("address_key string, lat double, lon double, precision string, looked_up_at timestamp"), none("zip string, lat double, lon double"), none("state string, place string, lat double, lon double"),
        [classify.Profile("p", "box", TOPIC, trust_region=["cal-1"])], {"talk": ["machinery"]})


def _records(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """Customers as calendar events of three sources, hours apart; some lack a title, some a place, and some change on the second day."""
    k = F.col("c_custkey")
    start = F.lit("2026-10-02").cast("timestamp") + F.make_dt_interval(F.lit(0), (k * 3).cast("int"))
    again = F.when((k % 5 == 0) & F.lit(day > 1), F.lit(" again")).otherwise("")
    lines = F.array(F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT"), F.concat(F.lit("UID:"), k), F.when(k % 13 != 0, F.concat(F.lit("SUMMARY:Gathering "), k, F.lit(" "), "c_mktsegment", again)), F.concat(F.lit("DTSTART:"), F.date_format(start, "yyyyMMdd'T'HHmmss'Z'")), F.when(k % 4 != 0, F.lit("GEO:34.05;-118.24")).when(k % 8 == 0, F.lit("GEO:1.0;1.0")), F.lit("LOCATION:Hall\nEND:VEVENT\nEND:VCALENDAR"))
    feeds = spread(table(spark, sf_dir, "customer")).select(F.concat(F.lit("cal-"), k % 3).alias("source_id"), F.array_join(F.array_compact(lines), "\n").alias("body"), (F.lit(NOW).cast("timestamp") + F.make_dt_interval(F.lit(day))).alias("fetched_at"))
    return ics.read_ics(feeds).drop("pos")


_CUSTOMERS = """
c as (select c_custkey as k, c_custkey % 3 as s, 'Gathering ' || c_custkey || ' ' || c_mktsegment as title, lower(c_mktsegment) as segment, timestamp '2026-10-02' + to_hours(cast(c_custkey * 3 as int)) as start_utc,
  case when c_custkey % 4 <> 0 then 34.05 when c_custkey % 8 = 0 then 1.0 end as lat, c_custkey % 13 = 0 as bad from customer)
"""


@query("with " + _CUSTOMERS + """
select title, start_utc, cast(lat as double) as lat, case when segment = 'machinery' then ['talk'] when s = 0 then [] else ['meetup'] end as kinds, 'cal-' || s as source_id, case when lat > 30 then 'Box' end as area from c
where not bad and segment <> 'household' and (lat > 30 or (lat is null and s = 1))
""")
def run_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's run over customers as events: what its feed holds. It publishes to the shared folder."""
    state, report = daily.run(_empty(spark), _records(spark, sf_dir, 1), ics.parse_ics, _reference(spark), NOW, "r1", f"{shared_dir(spark)}/published")
    if not report.published:
        raise ValueError("nothing was published")
    feed = daily.feed(state, _reference(spark), NOW)
    return feed.select("title", "start_utc", "lat", F.array_sort("kinds").alias("kinds"), F.get("source_ids", F.lit(0)).alias("source_id"), "area")


@query("with " + _CUSTOMERS + """,
n as (select s, count(*) as n, count(*) filter (where bad) as bad, count(*) filter (where k % 5 = 0) as moved, count(*) filter (where k % 5 = 0 and bad) as moved_bad from c group by 1),
r as (select 'cal-' || s as source_id, 'r1' as run_id, n as fetched, n as changed, n - bad as parsed, bad as parse_errors, 'ok' as status from n
  union all select 'cal-' || s, 'r2', n, moved - moved_bad, moved - moved_bad, 0, 'ok' from n union all select 'cal-' || s, 'r3', n, 0, n - bad, bad, 'ok' from n where s = 1
  union all select 'cal-3', r, 0, 0, 0, 0, 'failed' from (values ('r1'), ('r2')) v(r))
select source_id, run_id, cast(fetched as bigint) as fetched, cast(changed as bigint) as changed, cast(parsed as bigint) as parsed, cast(parse_errors as bigint) as parse_errors, status from r
""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of two days, on the second of which some events changed, and of parsing one source's stored records again."""
    reference = _reference(spark)
    state, _, _ = daily.ingest(_empty(spark), _records(spark, sf_dir, 1), ics.parse_ics, reference, NOW, "r1")
    state, _, _ = daily.ingest(state, _records(spark, sf_dir, 2), ics.parse_ics, reference, NOW + dt.timedelta(days=1), "r2")
    state, metrics, _ = daily.replay(state, ["cal-1"], ics.parse_ics, reference, NOW + dt.timedelta(days=1), "r3")
    return state.runs.where("run_id <> 'r3' or source_id = 'cal-1'").select("source_id", "run_id", "fetched", "changed", "parsed", "parse_errors", "status")


# --- streams ---------------------------------------------------------------------------


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all input there is, by way of a table in the shared folder."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    _, marker = written_at(spark.range(0), name)
    job = stream.writeStream.format("parquet").outputMode("append").option("path", f"{marker}-out").option("checkpointLocation", f"{marker}-state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{marker}-out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    _, path = written_at(kept, "stream-in")
    return spark.readStream.schema(kept.schema).parquet(path)


@query("""
with r as (select event_type as source_id, cast(user_id as varchar) as native_id, cast(cast(floor(value / 20) as bigint) as varchar) as content_hash, ts as fetched_at from events),
l as (select *, lag(content_hash) over (partition by source_id, native_id order by fetched_at, content_hash) as before from r)
select source_id, native_id, content_hash, fetched_at from l where content_hash is distinct from before
""")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of records: those whose content differs from their key's last."""
    raw = _event_stream(spark, sf_dir).select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("native_id"), F.floor(F.col("value") / 20).cast("string").alias("content_hash"), F.col("ts").alias("fetched_at"))
    return _drained(jobs.stream_changes(raw), "stream-changes")


@query("with " + _VERDICTS + """,
i as (select *, len(reasons) = 0 as healthy, sum(case when len(reasons) = 0 then 1 else 0 end) over (partition by source_id order by started_at) as island from v),
s as (select *, sum(case when healthy then 0 else 1 end) over (partition by source_id, island order by started_at) as streak, min(case when not healthy then started_at end) over (partition by source_id, island order by started_at) as first_bad from i),
l as (select *, coalesce(lag(streak) over (partition by source_id order by started_at), 0) as before from s)
select source_id, started_at, cast(streak as bigint) as unhealthy_runs, case when not healthy then first_bad end as since, case when healthy then 'healthy' when streak >= 4 then 'disabled' else 'unhealthy' end as state,
  case when not healthy and streak in (2, 4) then 'alert' when healthy and before >= 2 then 'resolve' end as action from l
""")
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of health_states, from a stream of judged runs."""
    judged = _verdicts(spark, sf_dir).select("source_id", "run_id", F.col("started_at").cast("timestamp").alias("started_at"), "healthy")
    _, path = written_at(judged, "stream-in")
    found = _drained(jobs.stream_health(spark.readStream.schema(judged.schema).parquet(path), 2, 4), "stream-health")
    return found.select("source_id", "started_at", "unhealthy_runs", "since", "state", "action")


@query("with " + _VERDICTS + """,
i as (select *, len(reasons) = 0 as healthy, sum(case when len(reasons) = 0 then 1 else 0 end) over (partition by source_id order by started_at) as island from v),
s as (select *, sum(case when healthy then 0 else 1 end) over (partition by source_id, island order by started_at) as streak, min(case when not healthy then started_at end) over (partition by source_id, island order by started_at) as first_bad from i),
l as (select *, coalesce(lag(streak) over (partition by source_id order by started_at), 0) as before from s)
select source_id, started_at, typical, n_history, array_to_string(reasons, '; ') as reasons, cast(streak as bigint) as unhealthy_runs, case when not healthy then first_bad end as since, case when healthy then 'healthy' when streak >= 4 then 'disabled' else 'unhealthy' end as state,
  case when not healthy and streak in (2, 4) then 'alert' when healthy and before >= 2 then 'resolve' end as action from l
""")
def stream_run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and states of health_verdicts and health_states, from a stream of the runs themselves."""
    runs = _runs(spark, sf_dir).withColumn("started_at", F.col("started_at").cast("timestamp"))
    _, path = written_at(runs, "stream-in")
    found = _drained(jobs.stream_run_health(spark.readStream.schema(runs.schema).parquet(path), 0.9, 7, 3, 0.06, 2, 4), "stream-run-health")
    return found.select("source_id", "started_at", "typical", "n_history", F.array_join("reasons", "; ").alias("reasons"), "unhealthy_runs", "since", "state", "action")


@query("select event_type as profile_id, date_trunc('day', ts)::timestamp as day, cast(count(*) as bigint) as n from events group by 1, 2 having date_trunc('day', min(ts)) + interval 2 day <= (select max(ts) from events)")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a stream, of the days that are over for certain."""
    return _drained(jobs.stream_daily_new(_event_stream(spark, sf_dir).select(F.col("event_type").alias("profile_id"), F.col("ts").alias("first_seen"))), "stream-daily")


@query("select 'stream-000000000000' as run_id, event_type, cast(count(*) as bigint) as n from events group by 2")
def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files of a folder, each batch under a run id that stays the same when it is tried again."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    _, landing = written_at(events, "landing")
    out = f"{landing}-out"

    def ingest(batch: DataFrame, run_id: str) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(out)

    jobs.stream_ingest(spark, landing, "event_id long, event_type string", f"{landing}-state", ingest).awaitTermination()
    return spark.read.schema("event_type string, n long, run_id string").parquet(out)


@query("with " + _CUSTOMERS + " select title, start_utc, cast(lat as double) as lat, 'cal-' || s as source_id, k::varchar as native_id from c where not bad and (s <> 2 or lat > 30)")
def stream_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that come as files, a run for each, over a store; then once more from the beginning, which changes nothing."""
    records, landing = written_at(_records(spark, sf_dir, 1).repartition(2), "landing")
    reference = _reference(spark)
    reference.raw_path, reference.hash_path = f"{landing}-raw", f"{landing}-hashes"
    store = Store(spark, f"{landing}-store", _empty(spark))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    moment = lambda run_id: NOW + dt.timedelta(minutes=int(run_id.split("-")[1]))
    step = lambda state, batch, run_id: daily.ingest(state, batch, ics.parse_ics, reference, moment(run_id), run_id)[0]
    for turn in range(2):
        jobs.stream_runs(spark, landing, schema, f"{landing}-state{turn}", store, step, moment, 1).awaitTermination()
    return store.whole("events").join(store.whole("links").select("event_id", "native_id"), "event_id").select("title", "start_utc", "lat", F.col("primary_source").alias("source_id"), "native_id")
