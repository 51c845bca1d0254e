"""Whole feeds, robots files, slim forms, phrases and topics, on small cases."""

import datetime as dt
import json
import pathlib
import xml.etree.ElementTree as ET

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evlake.functions import geo, text
from evlake.operators import browse, classify, health, locate, publish, versions
from evlake.sources import geojson, ics, jsonld, robots



def now():
    return F.lit("2026-10-01").cast("timestamp")


FEED = "profile_id string, event_id string, start_utc timestamp, end_utc timestamp, title string, description string, organizer string, venue string, address string, lat double, lon double, status string, url string, kinds array<string>, first_seen timestamp, tz string"


def feed(spark, n=3):
    rows = [("p", f"e{i}", dt.datetime(2026, 10, 15) + dt.timedelta(hours=i), None, f"Title, <{i}>", "long " * 40, None, "Hall", "1 Main St", 1.5, 2.5, "scheduled", "https://x/1", ["talk"], dt.datetime(2026, 10, 1) + dt.timedelta(hours=i), "America/Los_Angeles") for i in reversed(range(n))]
    return spark.createDataFrame(rows, FEED).repartition(3)


def whole(spark, path, end="\n"):
    return end.join(r.value for r in spark.read.text(str(path), lineSep=end).collect())


def test_feeds_are_whole_documents(spark, tmp_path):
    names = spark.createDataFrame([("p", 'Name & "more"'), ("q", "None yet")], "profile_id string, name string")
    runs = spark.createDataFrame([("s", "ok", 1, 1, 1, 0), ("a", "failed", 0, 0, 0, 0)], "source_id string, status string, fetched int, changed int, parsed int, parse_errors int")
    assert publish.publish(feed(spark), runs, "r1", str(tmp_path), now(), names, "https://site.test/")
    tmp_path = pathlib.Path(publish.published(spark, str(tmp_path)))
    one = json.loads(whole(spark, tmp_path / "json/profile_id=p"))
    assert (one["count"], one["schema_version"], one["profile"]) == (3, 1, {"id": "p", "name": 'Name & "more"'}) and [e["event_id"] for e in one["events"]] == ["e0", "e1", "e2"] and list(one) == sorted(one)
    none = json.loads(whole(spark, tmp_path / "json/profile_id=q"))
    assert (none["count"], none["events"]) == (0, [])
    assert [e["event_id"] for e in json.loads(whole(spark, tmp_path / "new/profile_id=p"))["events"]] == ["e0", "e1", "e2"]
    calendar = whole(spark, tmp_path / "ics/profile_id=p", "\r\n")
    assert calendar.startswith("BEGIN:VCALENDAR\r\n") and calendar.rstrip().endswith("END:VCALENDAR") and all(len(x) <= 75 for x in calendar.split("\r\n"))
    again = ics.parse_ics(ics.read_ics(spark.createDataFrame([("s", calendar, dt.datetime(2026, 1, 1))], "source_id string, body string, fetched_at timestamp"))).collect()
    assert sorted((r.native_id, r.title, r.reason) for r in again) == [(f"e{i}", f"Title, <{i}>", None) for i in range(3)]
    channel = ET.fromstring(whole(spark, tmp_path / "rss/profile_id=p").encode()).find("channel")
    assert channel.find("title").text == 'Name & "more"' and [i.find("guid").text for i in channel.findall("item")] == ["e2", "e1", "e0"]
    manifest = json.loads(whole(spark, tmp_path / "manifest/profile_id=q"))
    assert manifest["counts"] == {"new": 0, "upcoming": 0} and [s["source_id"] for s in manifest["sources"]] == ["a", "s"]


def test_a_broken_run_leaves_the_one_before(spark, tmp_path, monkeypatch):
    """Broken off at any sink, a run isn't seen; tried again, it is; the run before it stays for those who read it."""
    runs = spark.createDataFrame([("s", "ok", 1, 1, 1, 0)], "source_id string, status string, fetched int, changed int, parsed int, parse_errors int")
    path = str(tmp_path)
    seen = lambda: json.loads(whole(spark, f"{publish.published(spark, path)}/json/profile_id=p"))["count"]
    assert publish.published(spark, path) is None
    publish.publish(feed(spark, 2), runs, "r1", path, now())
    first = publish.published(spark, path)
    for sink in ("write_json_feed", "write_ics_feed", "write_rss_feed", "_write"):
        with monkeypatch.context() as m:
            m.setattr(publish, sink, lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                publish.publish(feed(spark, 3), runs, "r2", path, now())
        assert publish.published(spark, path) == first and seen() == 2
        assert json.loads(whole(spark, f"{first}/manifest/profile_id=p"))["run_id"] == "r1"
    publish.publish(feed(spark, 3), runs, "r2", path, now())
    assert seen() == 3 and spark.read.text(f"{first}/json").count() > 0
    publish.publish(feed(spark, 4), runs, "r3", path, now())
    assert seen() == 4 and not pathlib.Path(first).exists()
    with pytest.raises(PySparkException):  # another writer was first
        versions.commit(spark, path, 1, {})


def test_calendar_lines_stay_within_octets(spark):
    texts = ["ü" * 200, "日本" * 90, "a" * 73 + "é" + "b" * 80, "a" * 74 + "😀" * 50, "plain " * 40, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", publish.fold_line(F.col("t")).alias("f")).collect()
    for r in rows:
        if r.t is not None:
            assert all(len(line.encode()) <= 75 for line in r.f.split("\r\n")) and r.f.replace("\r\n ", "") == r.t
        else:
            assert r.f is None


def robots_rules(spark, body, agent="crawler"):
    return sorted((r.pattern, r.allow) for r in robots.read_robots(spark.createDataFrame([("a.test", body)], "host string, body string"), agent).collect())


def test_robots_agents_are_compared_whole(spark):
    assert robots_rules(spark, "User-agent: craw\nDisallow: /a\nUser-agent:\nDisallow: /b\nUser-agent: *\nDisallow: /c") == [("/c", False)]
    assert robots_rules(spark, "User-agent: crawler\nSitemap: https://a.test/s.xml\nUser-agent: other\nDisallow: /") == [("/", False)]
    assert robots_rules(spark, "User-agent: other\nUser-agent: Crawler\nDisallow:\n\nUser-agent: *\nDisallow: /") == []
    assert robots_rules(spark, "User-agent: *\rDisallow: /x\r\nAllow: /x/y", "Crawler/2.0 (+https://c.test)") == [("/x", False), ("/x/y", True)]


def test_slim_forms(spark):
    a = '{"name":"A","image":1,"location":[{"@type":"Place","name":"H","photo":"p","geo":{"longitude":2,"latitude":1}},"Online"],"organizer":{"name":"O","telephone":"1"}}'
    b = '{"organizer":{"telephone":"2","name":"O"},"location":[{"geo":{"latitude":1,"longitude":2},"name":"H","@type":"Place"},"Online"],"name":"A"}'
    row = spark.createDataFrame([(a, b)], "a string, b string").select(jsonld.slim(F.col("a")).alias("a"), jsonld.slim(F.col("b")).alias("b")).first()
    assert row.a == row.b and "photo" not in row.a and "telephone" not in row.a and "Online" in row.a and "latitude" in row.a


def test_places(spark):
    texts = ["1 A St, Portland, Oregon", "1 A St, Portland, OR 97201", "Costa Mesa, CA 92626, USA, California", "X, Washington, DC", "Paris, France", None]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select(geo.city_of(F.col("a")).alias("c")).collect()
    assert [r.c for r in rows] == [None, "Portland", "Costa Mesa", None, None, None]
    zips = spark.createDataFrame([("92507", 1.0, 2.0), ("10001", 3.0, 4.0)], "zip string, lat double, lon double")
    keys = spark.createDataFrame([("1 main st, riverside, california 92507",), ("x, ny 10001, california 92507-1234",), ("12345 de 92507",), ("texas 92507",)], "address_key string")
    assert {r.address_key: r.lat for r in locate.postal_points(keys, zips).collect()} == {"1 main st, riverside, california 92507": 1.0, "x, ny 10001, california 92507-1234": 1.0, "12345 de 92507": 1.0}


def test_a_region_without_polygons_fails(spark):
    with pytest.raises(PySparkException, match="no polygon in region x"):
        geojson.polygons(spark.createDataFrame([("x", '{"type":"FeatureCollection","features":[]}')], "region_id string, body string")).collect()


def test_a_phrase_hides_longer_ones(spark):
    assert text.visible_phrases(["hack", "hack night", "hackathon", "C++", "c", "ai", " AI-lab ", ""]) == [["ai"], ["c"], ["hack"], ["hackathon"]]
    found = spark.createDataFrame([("Hack-night at the hackathon, a C++ evening; Éhack, re-hack",)], "t string").select(text.phrases_found(F.col("t"), ["hack", "hack night", "hackathon", "c++"]).alias("f")).first().f
    assert found == ["c++", "hack", "hackathon"]


TOPIC = classify.Topic(["ai", "coding", "python", "developer", "software", "robotics", "hack", "startup founders", "machine learning"], ["real estate", "astrology"], 2, 1)
#: title, description, whether its source is trusted, whether it is on topic
TITLES = [
    ("Coding Club of the Coast", "", False, True), ("Robotics Open Evening", "", False, True), ("Machine-Learning Lunch", "", False, True), ("Founders Coffee", "Meet startup founders and developer friends.", False, True), ("Dinner", "Talks on python and software.", False, True),
    ("Dinner", "A word on python.", False, False), ("Dinner", "A word on python.", True, True), ("Pottery and Paint", "", False, False), ("Real Estate and AI Meetup", "", False, False), ("Astrology of Software", "python software", True, False), ("Gala of the Year", None, True, False), (None, None, False, False),
    ("Hackathons Galore", "", False, False), ("Paint, then Hack", "", False, True),
]


def test_labelled_topics(spark):
    rows = spark.createDataFrame(TITLES, "title string, about string, trusted boolean, label boolean")
    judged = rows.withColumns({"predicted": F.coalesce(classify.topic_match(F.col("title"), F.col("about"), F.col("trusted"), TOPIC), F.lit(False)).cast("int"), "label": F.col("label").cast("int")})
    assert classify.label_metrics(judged).first().accuracy == 1.0


def test_skipped_sources_and_their_alerts(spark):
    days = [(s, f"{d:02d}", dt.datetime(2026, 9, d), "ok" if good else "failed", 5 if good else 0) for s, marks in (("a", "+" * 9), ("b", "+" + "-" * 8)) for d, good in enumerate((m == "+" for m in marks), 1)]
    runs = spark.createDataFrame(days, "source_id string, run_id string, started_at timestamp, status string, fetched long").withColumns({c: F.col("fetched") for c in ("changed", "parsed")} | {"parse_errors": F.lit(0), "error": F.lit(None).cast("string")})
    states = health.source_states(runs)
    assert {(r.source_id, r.state) for r in states.collect()} == {("a", "healthy"), ("b", "disabled")}
    sources = spark.createDataFrame([("a",), ("b",), ("new",)], "source_id string")
    when = lambda day: F.lit(f"2026-09-{day}").cast("timestamp")
    assert {(r.source_id, r.fetch) for r in health.select_sources(sources, states, when(12)).collect()} == {("a", True), ("b", False), ("new", True)}
    assert health.select_sources(sources, states, when(16)).where("not fetch").count() == 0
    skipped = health.skipped_runs(health.select_sources(sources, states, when(12)), "r", when(12)).collect()
    assert [(r.source_id, r.status, r.fetched) for r in skipped] == [("b", "disabled", 0)]
    told = health.alerts(health.states(health.verdicts(runs))).collect()
    assert [(r.source_id, r.action, r.title) for r in sorted(told, key=lambda r: r.run_id)] == [("b", "alert", "Source b is unhealthy"), ("b", "alert", "Source b is disabled")]


def test_browsing(spark):
    rows = feed(spark, 30).withColumns({"attendance_mode": F.lit("in_person"), "area": F.when(F.col("event_id") < "e15", F.lit("Irvine")).otherwise("irvine"), "source_ids": F.array(F.lit("luma-a"))})
    shown = browse.browse(rows, "title main", None, "city", "10", 9).collect()
    assert {(r.page, r.pages, r["first"], r["last"], r.matched, r.total) for r in shown} == {(3, 3, 21, 30, 30, 30)}
    one = browse.page_groups(browse.browse(rows, "", "talk", "city", "25"), "event_id", ["start_utc", "event_id"]).collect()
    assert [(r.heading.lower(), len(r.members)) for r in one] == [("irvine", 25)]
    assert {r.heading for r in browse.browse(rows, sort="source", prefixes={"luma-": "Luma"}).collect()} == {"Luma"} and browse.browse(rows, "nothing").count() == 0
