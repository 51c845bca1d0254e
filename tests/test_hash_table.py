"""The table of latest hashes against the whole log."""

import datetime as dt
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evlake.operators import changes, hash_table, storage, versions

KEYS = ["source_id", "native_id"]
RAW = "source_id string, native_id string, content_hash string, payload string, fetched_at timestamp"


def records(spark, rng, day):
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(days=day, minutes=rng.randrange(1000))
    rows = [(rng.choice("ab"), rng.choice([None, *map(str, range(60))]), f"h{rng.randrange(4)}", "p" * 500, at()) for _ in range(rng.randrange(25))]
    return spark.createDataFrame(list({r[:2]: r for r in rows}.values()), RAW)


def test_thirty_days_equal_the_whole_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_table, "MAX_DELTAS", 3)
    rng = random.Random(8)
    table = hash_table.HashTable(spark, str(tmp_path / "t"), KEYS, buckets=8)
    log, kinds = [], set()
    for day in range(30):
        incoming = records(spark, rng, day)
        whole = spark.createDataFrame(log, RAW)
        want = sorted(map(repr, changes.detect_changes(incoming, changes.latest_hashes(whole, KEYS, "fetched_at"), KEYS).select(*KEYS, "change").collect()))
        run = f"r{day}"
        for _ in range(2 if day % 7 == 3 else 1):  # some runs are tried again after their commit
            told = table.detect(incoming, run)
            assert sorted(map(repr, told.select(*KEYS, "change").collect())) == want, day
            table.append(told.where("change <> 'unchanged'"), run)
        log += [tuple(r)[:5] for r in told.where("change <> 'unchanged'").select(*[c.split()[0] for c in RAW.split(", ")]).collect()]
        kinds |= {s["kind"] for s in versions.current(spark, table.path)[1]["segments"]}
        assert len(versions.current(spark, table.path)[1]["segments"]) <= 5
    assert kinds == {"base", "delta", "merged"}
    newest = changes.latest_hashes(spark.createDataFrame(log, RAW), KEYS, "fetched_at")
    assert sorted(map(repr, table.latest().collect())) == sorted(map(repr, newest.collect()))


def test_only_touched_buckets_and_no_payload_are_read(spark, tmp_path):
    table = hash_table.HashTable(spark, str(tmp_path / "t"), KEYS, buckets=16)
    rows = spark.range(400).selectExpr("'s' as source_id", "cast(id as string) as native_id", "'h' as content_hash", "repeat('p', 100) as payload", "timestamp '2026-01-01' as fetched_at")
    table.append(rows, "r1")
    few = rows.where("native_id in ('3', '5')")
    touched = table.touched(few)
    plan = table.detect(few, "r2")._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in plan.split("\n") if "bucket#" in line and "FileScan" in line]
    assert len(touched) == 2 and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(" + ",".join(map(str, touched)), scan) and "payload" not in scan
    assert {r.change for r in table.detect(few, "r2").collect()} == {"unchanged"}
    assert {r.change for r in table.detect(few, "r1").collect()} == {"new"}  # its own delta isn't seen by a run that is tried again


def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = hash_table.HashTable(spark, str(tmp_path / "t"), KEYS, buckets=4)
    rows = spark.createDataFrame([("s", "1", "h", "p", dt.datetime(2026, 1, 1))], RAW)
    table.append(rows, "r1")
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.append(rows.withColumn("content_hash", F.lit("other")), "r2")
    assert [r.content_hash for r in table.latest().collect()] == ["h"]
    with pytest.raises(PySparkException):
        versions.commit(spark, table.path, 0, {})
    assert hash_table.HashTable(spark, str(tmp_path / "none"), KEYS).latest() is None


def test_scratch_deletes_what_was_written_within(spark):
    _, before = storage.written_at(spark.range(3), "kept")
    with storage.scratch(spark):
        table, inner = storage.written_at(spark.range(3), "gone")
        with storage.scratch(spark):
            _, deeper = storage.written_at(spark.range(3), "gone")
        assert table.count() == 3
        with pytest.raises(PySparkException):
            spark.read.parquet(deeper)
    with pytest.raises(PySparkException):
        spark.read.parquet(inner)
    assert spark.read.parquet(before).count() == 3
