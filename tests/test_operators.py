import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evlake.operators import browse, changes, classify, components, folds, health, publish, resolve, spatial
from evlake.sources import geojson


def at(text):
    return dt.datetime.fromisoformat(text)


def sequential_upsert(rows):
    """The fold, a row at a time."""
    state, primary, rank = {"title": None, "status": None, "lat": None, "precision": None}, None, None
    for ord_, source, priority, title, status, lat, precision in rows:
        if ord_ == 0:
            state, primary, rank = {"title": title, "status": status, "lat": lat, "precision": precision}, source, priority
            continue
        leads = primary is None or source == primary or priority > rank
        if title is not None and (leads or state["title"] is None):
            state["title"] = title
        if leads or status == "cancelled":
            state["status"] = status
        if lat is not None and (leads or state["lat"] is None or state["precision"] in ("postal", "place")):
            state["lat"], state["precision"] = lat, None
        if leads:
            primary, rank = source, priority
    return state["title"], state["status"], state["lat"], state["precision"], primary


def test_upsert_fold_equals_a_sequential_fold(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for key in range(300):
        case = []
        for ord_ in range(rng.randint(1, 6)):
            case.append((ord_, rng.choice("abc"), None, rng.choice([None, f"t{ord_}"]), rng.choice(["scheduled", "cancelled"]), rng.choice([None, float(ord_)]), None))
        case = [(o, s, {"a": 1, "b": 2, "c": 2}[s], t, st, lat, rng.choice(["place", None]) if o == 0 and lat is not None else None) for o, s, _, t, st, lat, _ in case]
        want[key] = sequential_upsert(case)
        rows += [(key, *c, c[0] == 0) for c in case]
    table = spark.createDataFrame(rows, "key long, ord long, source string, priority int, title string, status string, lat double, geo_precision string, is_stored boolean").withColumn("lon", F.col("lat"))
    got = {r.key: (r.title, r.status, r.lat, r.geo_precision, r.primary_source) for r in folds.upsert_fold(table, "key", "ord", "source", "priority", ["title"]).collect()}
    # a second draft's point does not replace a first one's unless it leads, also where the first came from a centroid
    assert got == want


def test_merge_fold_cancelled_and_location(spark):
    rows = [("g", 1, "a", 1, "x", "scheduled", None, None), ("g", 2, "b", 5, None, "cancelled", 2.0, "place"), ("g", 3, "c", 9, "z", "scheduled", 3.0, None)]
    table = spark.createDataFrame(rows, "key string, ord long, source string, priority int, title string, status string, lat double, geo_precision string").withColumns({"lon": F.col("lat"), "first_seen": F.lit(1), "last_seen": F.lit(2)})
    got = folds.merge_fold(table, "key", "ord", "source", "priority", ["title"]).first()
    assert (got.title, got.status, got.lat, got.geo_precision) == ("z", "cancelled", 3.0, None)


def test_aliases_stay_one_step_deep(spark):
    aliases = spark.createDataFrame([("a", "b", 1)], "alias_id string, event_id string, merged_at int")
    merges = spark.createDataFrame([("b", "c", 2)], "loser string, survivor string, merged_at int")
    assert sorted(tuple(r) for r in folds.resolve_aliases(aliases, merges).collect()) == [("a", "c", 1), ("b", "c", 2)]


def test_changes_and_prune(spark):
    raw = spark.createDataFrame([("s", "1", "h1", at("2026-01-01")), ("s", "1", "h2", at("2026-01-02")), ("s", "2", "h3", at("2026-01-01"))], "source_id string, native_id string, content_hash string, fetched_at timestamp")
    latest = changes.latest_versions(raw, ["source_id", "native_id"], "fetched_at")
    new = spark.createDataFrame([("s", "1", "h1"), ("s", "2", "h3"), ("s", "3", "h9"), ("s", None, "h9")], "source_id string, native_id string, content_hash string")
    got = {r.native_id: r.change for r in changes.detect_changes(new, latest, ["source_id", "native_id"]).collect()}
    assert got == {"1": "changed", "2": "unchanged", "3": "new", None: "new"}
    assert changes.prune(raw, ["source_id", "native_id"], "fetched_at", F.lit("2026-02-01").cast("timestamp")).count() == 2


def test_fetch_outcome(spark):
    rows = spark.createDataFrame([(200, {}, "GET"), (503, {}, "GET"), (404, {}, "GET"), (202, {}, "GET"), (202, {}, "POST"), (403, {"CF-Mitigated": "challenge"}, "GET")], "status int, headers map<string,string>, method string")
    assert [r[0] for r in rows.select(changes.fetch_outcome(F.col("status"), F.col("headers"), F.col("method"))).collect()] == ["ok", "retry", "error", "challenge", "ok", "challenge"]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_duplicates_follow_the_rule(spark):
    t = "2026-10-14T18:00:00"
    rows = [
        ("a1", "OCC Hacks", t, 33.6695, -117.9120, False, None), ("a2", "OCCHacks", "2026-10-14T18:30:00", 33.6697, -117.9118, False, None),
        ("b1", "Tech Night", "2026-11-14T18:00:00", 33.6, -117.9, False, None), ("b2", "Board game evening", "2026-11-14T18:00:00", 33.6, -117.9, False, None),
        ("c1", "Demo", "2026-12-01T01:00:00", None, None, False, "https://x/1"), ("c2", "Other words", "2026-12-01T01:10:00", None, None, False, "https://x/1"),
        ("d1", "Workshop #73", "2027-01-01T01:00:00", 34.0, -118.0, False, None), ("d2", "Workshop #73", "2027-01-01T01:10:00", 34.1, -118.1, False, None), ("d3", "Workshop #74", "2027-01-01T01:10:00", 34.2, -118.2, False, None),
    ]
    table = spark.createDataFrame([(i, ti, at(s), la, lo, ap, u) for i, ti, s, la, lo, ap, u in rows], "event_id string, title string, start_utc timestamp, lat double, lon double, approximate boolean, url string")
    pairs = {(r[0], r[1]) for r in resolve.duplicate_pairs(table).collect()}
    assert {tuple(sorted(p)) for p in pairs} == {("a1", "a2"), ("c1", "c2"), ("d1", "d2")}
    assert {r.event_id: r.survivor for r in resolve.survivors(resolve.duplicate_pairs(table)).collect()}["d2"] == "d1"


def test_band_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, at("2026-01-01") + dt.timedelta(seconds=rng.randrange(20000))) for i in range(150)]
    table = spark.createDataFrame(rows, "id long, k long, t timestamp")
    got = sorted(tuple(sorted((r.a_id, r.b_id))) for r in resolve.band_pairs(table, ["k"], "t", 900, "id").collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs((a[2] - b[2]).total_seconds()) <= 900)
    assert got == want


def test_regions_with_a_hole(spark):
    body = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[3,1],[3,3],[1,3],[1,1]]]}'
    polygons = geojson.polygons(spark.createDataFrame([("r", body)], "region_id string, body string"))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 9.0), (4, None, 1.0)], "id int, lat double, lon double")
    assert [r.id for r in spatial.region_members(points, polygons, ["id"]).collect()] == [1]
    assert {r.id: r.area for r in spatial.area_labels(points, polygons, ["id"]).collect()} == {1: None, 2: None, 3: None, 4: None}
    assert geojson.check_polygons(spark.createDataFrame([("x", '{"type":"FeatureCollection","features":[]}')], "region_id string, body string")).count() == 1


def test_membership_rules(spark):
    topic = classify.Topic(["ai"], ["crypto"], 2, 1)
    profile = classify.Profile("p", "r", topic, trust_region=["tr"], trust_topic=["tt"], topic_always=["ta"])
    cases = [
        (["x"], True, True, "in_person", "AI night", "", True), (["x"], False, True, "in_person", "AI night", "", False), (["tr"], False, False, "in_person", "AI night", "", True),
        (["x"], True, True, "online", "AI night", "", False), (["ta"], True, True, "in_person", "Dinner", "", True), (["tt"], True, True, "in_person", "Dinner", "on ai", True),
        (["x"], True, True, "in_person", "Dinner", "on ai", False), (["tt"], True, True, "in_person", "Crypto AI", "ai", False), (None, True, True, "in_person", None, None, False),
    ]
    table = spark.createDataFrame(cases, "s array<string>, inside boolean, located boolean, mode string, title string, about string, want boolean")
    rows = table.select("want", classify.admits(profile, *[F.col(c) for c in ("s", "inside", "located", "mode", "title", "about")]).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_health_states_over_days(spark):
    marks = [True, False, False, False, True, False]
    rows = [("s", str(i), at("2026-01-01") + dt.timedelta(days=i), h) for i, h in enumerate(marks)]
    got = health.states(spark.createDataFrame(rows, "source_id string, run_id string, started_at timestamp, healthy boolean"), alert_after=2, disable_after=3).orderBy("started_at").collect()
    assert [(r.state, r.unhealthy_runs, r.action) for r in got] == [("healthy", 0, None), ("unhealthy", 1, None), ("unhealthy", 2, "alert"), ("disabled", 3, "alert"), ("healthy", 0, "resolve"), ("unhealthy", 1, None)]


def test_schema_diff(spark):
    old = spark.createDataFrame([], "a int, b struct<c: string, d: int>, e array<struct<f: int>>").schema
    new = spark.createDataFrame([], "a long, b struct<c: string>, e array<struct<f: int, g: int>>, z int").schema
    assert publish.schema_diff(old, new) == [("a", "int became bigint"), ("b.d", "removed")]


def test_pages_and_next(spark):
    rows = spark.createDataFrame([(f"e{i:03d}", at("2026-01-01")) for i in range(60)], "event_id string, start_utc timestamp")
    last = browse.page(rows, ["start_utc", "event_id"], "25", 99).collect()
    assert [r.event_id for r in last] == [f"e{i:03d}" for i in range(50, 60)] and (last[0].page, last[0].pages, last[0]["first"], last[0]["last"]) == (3, 3, 51, 60)
    assert browse.page(rows.limit(0), ["event_id"], "x", 1).count() == 0
    assert [r.event_id for r in browse.after(rows, at("2026-01-01"), "e010", 2).collect()] == ["e011", "e012"]


def test_feeds(spark, tmp_path):
    feed = spark.createDataFrame([("p", "e1", at("2026-10-15T01:00:00"), None, "A, B & C", "long " * 40, None, "Hall", "1 Main St", 1.5, 2.5, "cancelled", "https://x/1", ["talk", "meetup"], at("2026-10-01"), "America/Los_Angeles")],
        "profile_id string, event_id string, start_utc timestamp, end_utc timestamp, title string, description string, organizer string, venue string, address string, lat double, lon double, status string, url string, kinds array<string>, first_seen timestamp, tz string")
    ics = feed.select(publish.ics_event(F.lit("2026-10-01").cast("timestamp"))).first()[0]
    assert "SUMMARY:A\\, B & C" in ics and "STATUS:CANCELLED" in ics and "CATEGORIES:meetup,talk" in ics and all(len(x) <= 75 for x in ics.split("\r\n"))
    item = feed.select(publish.rss_item()).first()[0]
    assert "<title>A, B &amp; C</title>" in item and "CANCELLED\nWed, Oct 14 2026, 6:00 PM PDT" in item
    runs = spark.createDataFrame([("s", "ok", 1, 1, 1, 0)], "source_id string, status string, fetched int, changed int, parsed int, parse_errors int")
    assert publish.publish(feed, runs, "r1", str(tmp_path / "out"), F.lit("2026-10-01").cast("timestamp"))
    assert '"run_id":"r1"' in spark.read.text(f"{publish.published(spark, str(tmp_path / 'out'))}/manifest").first().value
    failed = runs.withColumn("status", F.lit("failed"))
    assert not publish.publish(feed, failed, "r2", str(tmp_path / "none"), F.lit("2026-10-01").cast("timestamp")) and not (tmp_path / "none").exists()
