import datetime as dt
import json

from pyspark.sql import functions as F

from evlake.operators import classify, publish
from evlake.plans import run as daily
from evlake.sources import geojson, ics

NOW = dt.datetime(2026, 10, 1)
EVENT = "event_id string, title string, description string, start_utc timestamp, end_utc timestamp, tz string, venue string, address string, lat double, lon double, attendance_mode string, status string, organizer string, url string, kinds array<string>, size_signal bigint, rule_kinds array<string>, geo_precision string, primary_source string, first_seen timestamp, last_seen timestamp"


def feed_text(title, start="20261014T180000Z", uid="1", geo="34.05;-118.24"):
    return "\n".join(["BEGIN:VCALENDAR", "BEGIN:VEVENT", f"UID:{uid}", f"SUMMARY:{title}", f"DTSTART:{start}", f"GEO:{geo}", "LOCATION:Hall", "END:VEVENT", "BEGIN:VEVENT", "UID:bad", "DTSTART:20261014", "END:VEVENT", "END:VCALENDAR"])


def setup(spark):
    empty = lambda s: spark.createDataFrame([], s)
    state = daily.State(
        empty(EVENT), empty("source_id string, native_id string, event_id string, url string, content_hash string"), empty("source_id string, native_id string, content_hash string, payload string, fetched_at timestamp, run_id string"),
        empty("source_id string, run_id string, started_at timestamp, status string, fetched long, changed long, parsed long, parse_errors long, error string"), empty("event_id string, profile_id string, first_seen timestamp"), empty("alias_id string, event_id string, merged_at timestamp"))
    square = '{"type":"Feature","properties":{"name":"LA"},"geometry":{"type":"Polygon","coordinates":[[[-119,33],[-117,33],[-117,35],[-119,35]]]}}'
    reference = daily.Reference(
        spark.createDataFrame([("a", True, 50, ["meetup"], None), ("b", True, 90, ["talk"], None)], "source_id string, enabled boolean, priority int, default_kinds array<string>, keep_region string"),
        geojson.polygons(spark.createDataFrame([("la", square)], "region_id string, body string")), empty("address_key string, lat double, lon double, precision string, looked_up_at timestamp"),
        empty("zip string, lat double, lon double"), empty("state string, place string, lat double, lon double"), [classify.Profile("p", "la", classify.Topic(["ai"]))], {"hackathon": ["hack"]})
    return state, reference


def records(spark, *feeds):
    return ics.read_ics(spark.createDataFrame([(s, body, NOW) for s, body in feeds], "source_id string, body string, fetched_at timestamp")).drop("pos")


def test_a_day_and_the_next(spark, tmp_path):
    state, reference = setup(spark)
    reference.raw_path, reference.hash_path = str(tmp_path / "raw"), str(tmp_path / "hashes")
    incoming = records(spark, ("a", feed_text("AI Night")), ("b", feed_text("AI Night!", uid="9")))
    state, report = daily.run(state, incoming, ics.parse_ics, reference, NOW, "r1", str(tmp_path / "one"))
    (event,) = state.events.collect()
    # two postings of one event: the higher priority's title, the lower id
    assert report.published and event.title == "AI Night!" and event.rule_kinds == ["meetup", "talk"] and state.links.count() == 2 and state.aliases.count() == 1
    assert {(r.source_id, r.fetched, r.parsed, r.parse_errors) for r in state.runs.collect()} == {("a", 2, 1, 1), ("b", 2, 1, 1)}
    document = json.loads("\n".join(r.value for r in spark.read.text(f"{publish.published(spark, str(tmp_path / 'one'))}/json").collect()))
    assert (document["count"], document["profile"], [e["title"] for e in document["events"]]) == (1, {"id": "p", "name": "p"}, ["AI Night!"])
    assert report.alerts.count() == 0 and {(r.source_id, len(r.records)) for r in report.drift.collect()} == {("a", 2), ("b", 2)}
    again, _, _ = daily.ingest(state, incoming, ics.parse_ics, reference, NOW + dt.timedelta(days=1), "r2")
    assert {(r.source_id, r.changed) for r in again.runs.where("run_id = 'r2'").collect()} == {("a", 0), ("b", 0)}
    assert sorted(r.run_id for r in spark.read.parquet(reference.raw_path).collect()) == ["r1"] * 4
    (same,) = again.events.collect()
    assert same.title == event.title and same.last_seen > event.last_seen
    replayed, metrics, rejects = daily.replay(state, ["a"], ics.parse_ics, reference, NOW, "r3")
    assert replayed.events.count() == 1 and rejects.count() == 1


def test_nothing_is_published_when_all_sources_fail(spark, tmp_path):
    state, reference = setup(spark)
    _, report = daily.run(state, records(spark), ics.parse_ics, reference, NOW, "r1", str(tmp_path / "none"))
    assert not report.published and not (tmp_path / "none").exists()
