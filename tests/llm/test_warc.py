"""Archives: round trips, pushed predicates, ranges, and results against plain Python."""

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from evlake.llm import queries, warc
from evlake.operators.storage import shared_dir

SF = "/root/testdata/sf0.001"


def folder(spark):
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"


def expected(pages):
    by = {}
    for i, html in pages:
        by.setdefault(html or "", []).append(i)
    out = []
    for html, ids in by.items():
        known = [i for i in ids if i is not None]
        keeper = max(known) if known else None
        data = html.encode()
        for i in ids:
            own = i == keeper
            out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else keeper))
    return sorted(out, key=repr)


def test_query_against_plain_python(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op11_warc(spark, SF).collect()), key=repr) == expected(pages)


def test_odd_pages(spark):
    rows = [(1, "http://a/x y\r\nWARC-Type: revisit", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone"), (5, "u", "ü\r\n\r\nWARC/1.1\r\n" * 50_000)]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, payload string, key int")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == expected([(r[0], r[2]) for r in rows])
    assert warc.round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("packed", ["true", "false"])
def test_predicates_ranges_and_files(spark, packed, monkeypatch):
    monkeypatch.setattr(warc, "PART_BYTES", 2000)
    path = folder(spark)
    warc.register(spark)
    ids = spark.range(400).select(F.concat(F.lit("urn:x:"), "id").alias("record_id"), F.when(F.col("id") % 4 == 0, "metadata").otherwise("response").alias("record_type"), F.concat(F.lit("http://h/"), F.col("id")).alias("target_uri"), F.encode(F.repeat(F.concat(F.lit("text "), F.col("id").cast("string")), 50), "utf-8").alias("payload"))
    ids.write.format("warc").option("gzip", packed).option("fileBytes", "20000").mode("append").save(path)
    every = warc.read_warc(spark, path)
    assert every.count() == 400
    fs, at = warc._files(path)
    assert len(warc.read_manifest(fs, at)) > 2
    few = spark.read.format("warc").option("rangeBytes", "3000").load(path)
    assert few.rdd.getNumPartitions() > 4
    assert {r.record_id for r in few.collect()} == {f"urn:x:{i}" for i in range(400)}
    found = every.where("record_type = 'metadata' and target_uri like 'http://h/1%' and content_length > 0")
    assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString()  # all three are answered by the reader
    want = {i for i in range(400) if i % 4 == 0 and str(i).startswith("1")}
    assert {int(r.record_id.split(":")[-1]): bytes(r.payload).decode() for r in found.collect()} == {i: f"text {i}" * 50 for i in want}
    # a second write adds, overwriting leaves only its own files
    ids.limit(3).write.format("warc").option("gzip", packed).mode("append").save(path)
    assert warc.read_warc(spark, path, "record_id").count() == 403
    ids.limit(3).write.format("warc").mode("overwrite").save(path)
    assert warc.read_warc(spark, path, "record_id").count() == 3
    assert len([i for i in fs.get_file_info(pyarrow.fs.FileSelector(at)) if i.path.endswith(("warc", "gz"))]) == len(warc.read_manifest(fs, at))


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


@pytest.mark.parametrize("packed", [True, False])
def test_unwanted_payloads_are_passed_over(packed, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 4096)
    noise = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(30_000)).encode()
    parts = [warc.record_bytes("resource", f"urn:x:{k}", "2020-01-01T00:00:00Z", "u", None, noise, None) for k in range(3)]
    data = b"".join(warc._member(p, 6) if packed else p for p in parts)
    file = Counted(data)
    rows = list(warc.records(file, 0, None, lambda r: False, True, True, True))
    assert rows == [] and file.taken < len(data) / 20
    rows = list(warc.records(Counted(data), 0, None, lambda r: r["record_id"] == "urn:x:1", True, True, True))
    assert [(r["record_id"], r["payload"]) for r in rows] == [("urn:x:1", noise)]


def test_archives_of_others(spark, tmp_path):
    """Members without a length, folded headers, other letter case, an http head, several records of one file."""
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n<p>hello</p>"
    one = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:a>\r\nX-Note: one\r\n two\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(http), http)
    two = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(one + two)
    (tmp_path / "notes.txt").write_text("no archive")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("file", "record_id").collect()
    assert [(r.record_id, r.record_type, r.payload_bytes, bytes(r.payload)) for r in rows] == 2 * [("urn:a", "response", 12, b"<p>hello</p>"), ("urn:b", "warcinfo", 0, b"")]
    assert rows[0].headers["x-note"] == "one two"
    assert warc.read_warc(spark, str(tmp_path), "record_id", "refers_to").where("refers_to is null and record_id != 'urn:b'").count() == 2


def test_damage_is_told(tmp_path):
    whole = warc.record_bytes("resource", "urn:x", "2020-01-01T00:00:00Z", None, None, b"payload", None)
    read = lambda data: list(warc.records(io.BytesIO(data), 0, None, lambda r: True, True, True, True))
    assert read(whole)[0]["payload"] == b"payload" and read(b"") == []
    with pytest.raises(ValueError, match="digest"):
        read(whole.replace(b"payload\r\n\r\n", b"payl0ad\r\n\r\n"))
    with pytest.raises(ValueError, match="cut off"):
        read(whole[:-8])
    with pytest.raises(ValueError, match="no record"):
        read(b"junk\r\n\r\n" + whole)
    with pytest.raises(ValueError):
        read(warc._member(whole, 1)[:-20])


def test_filters_follow_sql(spark):
    """Negations and nulls of pushed filters, as Spark itself answers them."""
    path = folder(spark)
    warc.register(spark)
    spark.createDataFrame([("a", "urn:1", "urn:9"), ("b", "urn:2", None), ("c", "urn:3", "urn:8")], "record_type string, record_id string, refers_to string").write.format("warc").mode("append").save(path)
    rows = warc.read_warc(spark, path, "record_id", "record_type", "refers_to", "content_length")
    held = spark.createDataFrame(rows.collect(), rows.schema)
    for test in ("refers_to != 'urn:9'", "not(refers_to <=> 'urn:9')", "refers_to <=> null", "refers_to is null", "refers_to is not null", "record_type in ('a', 'b')", "record_type not in ('a', 'b')", "refers_to not in ('urn:9')", "record_type > 'a'", "record_type like '%b'", "not record_type like 'a%'", "content_length >= 0", "content_length < 0"):
        assert sorted(rows.where(test).collect()) == sorted(held.where(test).collect()), test
