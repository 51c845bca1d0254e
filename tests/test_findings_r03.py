"""Rows on which queries differed from their SQL, or were slow, in round 3."""

import datetime as dt

from pyspark.sql import functions as F

from evlake.functions import text
from evlake.operators import resolve
from evlake.plans import catalog, run_queries, source_queries
from evlake.sources import jsonld


def test_page_titles_keep_other_entities_and_cut_before_trimming(spark, tmp_path):
    long = "x" * 90
    titles = ["token = &quot;5a&quot; &amp; &lt;b&gt; &#35;", f" \n{long}", " a　", "a\x0bb", " \t "]
    rows = [(k, "u", f"<html><TITLE lang=en>{t}</TITLE>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r.title for r in catalog.QUERIES["page_titles"](spark, str(tmp_path)).collect()}
    assert found == {0: "token = &quot;5a&quot; & <b> &#35;", 1: "x" * 79, 2: "a", 3: "a\x0bb", 4: None}


def test_kept_in_region_holds_its_border(spark, tmp_path):
    rows = [(1, 40, "click", 0.0), (2, 40, "click", 0.01), (3, 0, "click", 0.0), (6, 40, "click", 0.0), (41, 40, "click", 0.0), (7, 90, "view", 1.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    events.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.event_id for r in catalog.QUERIES["kept_in_region"](spark, str(tmp_path)).collect()) == [1, 3, 7]


def test_small_files_are_spread_over_cores(spark):
    sf = "/root/testdata/sf0.001"
    assert source_queries._event_pages(spark, sf).rdd.getNumPartitions() > 1
    assert run_queries._records(spark, sf, 1).rdd.getNumPartitions() > 1
    plan = catalog.QUERIES["address_parts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_script_marks_go_as_before(spark):
    bodies = ['{"a":1}', ' <!-- {"a":1}\n--> ', '// <![CDATA[\n{"a":1}\n// ]]>\n', '/* <![CDATA[ */{"a":1}/* ]]> */', "<![CDATA[{}]]>", "<!-->", "", " \n", '{"a":"*/"}', "x*/", "{}//-->", "/* ]]> */"]
    rule = r"(?s)^\s*(?:<!--|//\s*<!\[CDATA\[|/\*\s*<!\[CDATA\[\s*\*/|<!\[CDATA\[)?(.*?)(?:-->|//\s*\]\]>|/\*\s*\]\]>\s*\*/|\]\]>)?\s*$"
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", jsonld._unwrapped(F.col("b")).alias("got"), F.regexp_replace("b", rule, "$1").alias("want")).collect()
    assert [r.got.strip() for r in rows] == [r.want.strip() for r in rows]


def test_titles_are_compared_once_however_many_events_have_them(spark, monkeypatch):
    """Events of a popular evening: pairs of titles are scored, not pairs of events."""
    scored = spark.sparkContext.accumulator(0)
    rows = [(f"{k:04d}", ["cold plate night", "old plate night"][k % 2], dt.datetime(2026, 10, 14, 18, k % 60), 34.0 + k % 7 / 1000, -118.0, k % 9 == 0, None) for k in range(400)]
    table = spark.createDataFrame(rows, "event_id string, title string, start_utc timestamp, lat double, lon double, approximate boolean, url string")
    real = text.subset_ratio
    monkeypatch.setattr(text, "subset_ratio", lambda a, b: (scored.add(1), real(a, b))[1])
    got = resolve.survivors(resolve.duplicate_pairs(table)).collect()
    assert len(got) == 400 and {r.survivor for r in got} == {"0000"}
    assert 1 <= scored.value <= 4
