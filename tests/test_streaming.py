import datetime as dt
import random
import time

from pyspark.sql import functions as F

from evlake.operators import health
from evlake.streaming import jobs


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def memory(df, name, mode, checkpoint):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def test_changes_pass_reverts(spark, tmp_path):
    schema = "source_id string, native_id string, content_hash string, fetched_at timestamp"
    for day, digest in enumerate("aabba", 1):
        spark.createDataFrame([("s", "1", digest, dt.datetime(2026, 1, day))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(memory(jobs.stream_changes(stream), "changed", "append", str(tmp_path / "c")))
    assert [r.content_hash for r in spark.table("changed").orderBy("fetched_at").collect()] == ["a", "b", "a"]


def test_a_key_of_many_records_and_forgotten_keys(spark, tmp_path):
    """A key's records in any order, far more than a portion; and a key that comes again after its time."""
    schema, folder, out = "source_id string, native_id string, content_hash string, fetched_at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    n = 9_000
    rows = spark.range(n).select(F.lit("s").alias("source_id"), F.lit("1").alias("native_id"), F.concat(F.lit("h"), (F.col("id") / 3).cast("int") % 7).alias("content_hash"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("fetched_at"))
    rows.repartition(4).write.parquet(folder)

    def run():
        found = jobs.stream_changes(spark.readStream.schema(schema).parquet(folder), dt.timedelta(seconds=1))
        drain(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        return spark.read.parquet(out).count()

    assert run() == n // 3
    time.sleep(1.5)
    rows.orderBy(F.desc("fetched_at")).limit(1).write.mode("append").parquet(folder)
    assert run() == n // 3 + 1


def test_health_equals_the_batch_form(spark, tmp_path):
    schema = "source_id string, run_id string, started_at timestamp, healthy boolean"
    rows = [(s, f"{i:02d}", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), (i * k) % 4 == 0) for s, k in (("a", 1), ("b", 3)) for i in range(12)]
    table = spark.createDataFrame(rows, schema)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(memory(jobs.stream_health(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 3), "states", "append", str(tmp_path / "c")))
    columns = ["source_id", "run_id", "unhealthy_runs", "since", "state", "action"]
    want = health.states(table, alert_after=2, disable_after=3).select(columns)
    assert sorted(map(str, spark.table("states").select(columns).collect())) == sorted(map(str, want.collect()))


def test_raw_runs_equal_the_batch_form_over_restarts(spark, tmp_path):
    """Runs in three portions, the stream started anew for each: baselines, verdicts and streaks go on."""
    schema = "source_id string, run_id string, started_at timestamp, status string, fetched long, parsed long, parse_errors long, error string"
    rng = random.Random(4)
    rows = []
    for s in "abc":
        for i in range(40):
            at = dt.datetime(2026, 1, 1) + dt.timedelta(days=i, hours=rng.randrange(3))
            rows.append((s, f"{i:02d}", at, rng.choice(["ok"] * 6 + ["failed", "disabled"]), rng.choice([0, 10, 10, 12, 50]), rng.randrange(9), rng.choice([0, 0, 0, 3]), rng.choice([None, "timeout"])))
    want = health.states(health.verdicts(spark.createDataFrame(rows, schema), window_days=6, min_history=2), alert_after=2, disable_after=3)
    columns = ["source_id", "run_id", "typical", "n_history", "reasons", "unhealthy_runs", "since", "state", "action"]
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([r for r in rows if int(r[1]) // 14 == part], schema).coalesce(1).write.mode("append").parquet(folder)
        found = jobs.stream_run_health(spark.readStream.schema(schema).parquet(folder), window_days=6, min_history=2, alert_after=2, disable_after=3)
        drain(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert sorted(map(str, spark.read.parquet(out).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_daily_counts_and_ingest(spark, tmp_path):
    schema = "profile_id string, event_id string, first_seen timestamp"
    rows = [("p", str(i), dt.datetime(2026, 1, 1 + i // 3)) for i in range(12)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(memory(jobs.stream_daily_new(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "daily", "append", str(tmp_path / "c")))
    got = {r.day.day: r.n for r in spark.table("daily").collect()}
    assert got and set(got.values()) == {3}
    seen = []
    drain(jobs.stream_ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "d"), lambda batch, run: seen.append((run, batch.count()))))
    assert seen == [("stream-000000000000", 12)]
