import datetime as dt

from pyspark.sql import functions as F

from evlake.operators import resolve
from evlake.operators.storage import written
from evlake.plans import run as daily
from evlake.plans import run_queries
from evlake.sources import ics


def test_a_run_sizes_tables_by_their_rows(spark):
    # a small file of alike rows was broadcast whole, and its rows are many times as large
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    none = run_queries._records(spark, "/root/testdata/sf0.001", 1).limit(3)
    daily.ingest(run_queries._empty(spark), none, ics.parse_ics, run_queries._reference(spark), run_queries.NOW, "r1")
    many = written(spark.range(300_000).select("id", F.lit("a place with a long name, alike for all").alias("place")), "many")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert before == "10485760b"
    plan = many.join(spark.range(10**9), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_crowd_takes_few_pairs(spark):
    # events of equal and of alike titles at one place and time were paired with one another
    start = dt.datetime(2026, 10, 14, 18)
    titles = ["Open Source Evening", "Open Source Evenings", "Rust Study Group"]
    rows = [(f"e{i:03d}", titles[i % 3], start + dt.timedelta(seconds=20 * i), 34.0 + i % 7 / 10_000, -118.0, i % 5 == 0, None) for i in range(300)]
    pairs = resolve.duplicate_pairs(spark.createDataFrame(rows, "event_id string, title string, start_utc timestamp, lat double, lon double, approximate boolean, url string")).persist()
    found = {r.event_id: r.survivor for r in resolve.survivors(pairs).collect()}
    assert found == {r[0]: "e002" if i % 3 == 2 else "e000" for i, r in enumerate(rows)}
    assert pairs.count() < 5 * len(rows)
