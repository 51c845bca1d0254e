import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evlake.functions import geo, keys, text, times, urls


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://User:pw@Example.COM:443/a?utm_source=x&b=2&a=1&Ref=z#top", "https://example.com/a?a=1&b=2"),
    ("http://example.com", "http://example.com/"),
    ("http://example.com:8080/x?k=", "http://example.com:8080/x?k="),
    ("not a url", "not a url"),
    (None, None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(("link", "want"), [
    ("/x/../y", "https://a.test/y"), ("b.html?q=1", "https://a.test/dir/b.html?q=1"), ("//c.test/z", "https://c.test/z"), ("#f", "https://a.test/dir/page?k=v#f"), ("?n=2", "https://a.test/dir/page?n=2"), ("http://d.test", "http://d.test"), ("../up", "https://a.test/up"),
])
def test_url_join(spark, link, want):
    assert one(spark, urls.url_join(F.lit("https://a.test/dir/page?k=v"), F.col("u")), u=link) == want


def test_redact_site_first_url(spark):
    assert one(spark, urls.redact_url(F.lit("https://me:pw@a.test/x?Token=abc&b=1"))) == "https://***@a.test/x?Token=***&b=1"
    assert one(spark, urls.site_key(F.lit("https://www.shop.example.co.uk/"))) == "example.co.uk"
    assert one(spark, urls.site_key(F.lit("https://m.blog.example.com/"))) == "example.com"
    assert one(spark, urls.first_url(F.lit("see https://a.test/b). or https://c.test;"))) == "https://a.test/b)"
    assert one(spark, urls.is_meeting_url(F.lit("https://us02.zoom.us/j/1")))


def test_refresh_spreads_keys_over_days(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"))
    due = [rows.where(urls.refresh_due(F.col("k"), F.lit(f"2026-10-{d:02d}").cast("date"), 7)).count() for d in range(1, 8)]
    assert sum(due) == 200 and min(due) > 5


@pytest.mark.parametrize(("value", "want"), [
    ("2026-10-14", dt.datetime(2026, 10, 14, 7)), ("2026-10-14T18:00:00", dt.datetime(2026, 10, 15, 1)), ("2026-10-14T18:00:00Z", dt.datetime(2026, 10, 14, 18)), ("2026-10-14T18:00:00-05:00", dt.datetime(2026, 10, 14, 23)), ("soon", None), ("", None), (None, None),
])
def test_parse_iso(spark, value, want):
    got = one(spark, F.date_format(times.parse_iso(F.col("t"), F.lit("America/Los_Angeles")), "yyyy-MM-dd HH:mm"), t=value)
    assert got == (want and want.strftime("%Y-%m-%d %H:%M"))


def test_times(spark):
    start, zone = F.lit("2026-10-15 01:00:00").cast("timestamp"), F.lit("America/Los_Angeles")
    assert one(spark, times.rss_when(start, zone)) == "Wed, Oct 14 2026, 6:00 PM PDT"
    assert one(spark, times.zone_for_offset(F.lit("2026-10-14T18:00:00-07:00"), zone)) == "America/Los_Angeles"
    assert one(spark, times.zone_for_offset(F.lit("2026-10-14T18:00:00-05:00"), zone)) is None
    assert one(spark, times.db_text(start)) == "2026-10-15T01:00:00.000000+00:00"
    assert one(spark, times.season_of(F.lit("2026-07-01").cast("date"))) == 2027
    assert [one(spark, times.duration_seconds(F.lit(x))) for x in ("PT1H30M", "P1DT2H", "P2W", "-PT5M", "no")] == [5400, 93600, 1209600, -300, None]
    none = F.lit(None).cast("timestamp")
    assert one(spark, times.when_label(F.lit("2026-10-14 07:00:00").cast("timestamp"), none, zone)) == "Wed, Oct 14, All day"


def test_clean_text_and_titles(spark):
    assert one(spark, text.clean_text(F.lit("<p>A&amp;B &#8217;s&nbsp; <b>x</b></p>"))) == "A&B ’s x"
    assert one(spark, text.clean_text(F.lit("<br> "))) is None
    assert one(spark, text.normalize_title(F.lit("ＡＩ Night #LATech 10/24/26, 2026!"))) == "ai night"
    assert one(spark, text.serials(F.lit("Workshop #73 on 10/24 2026, room 5"))) == ["5", "73"]
    assert one(spark, text.page_title(F.lit("<title> A\n &lt;b&gt; </title>"))) == "A <b>"


def test_phrases_shadow_in_sorted_order(spark):
    assert one(spark, text.phrases_found(F.lit("Hack-Night and HACK day; hacks"), ["hack", "hack night"])) == ["hack"]
    assert one(spark, text.phrases_found(F.lit("a Game  Jam"), ["game jam"])) == ["game jam"]
    assert one(spark, text.phrases_found(F.lit("Éduhack"), ["hack"])) == []


@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert text.common_subsequence(a, b) == table[-1][-1]


def test_geo(spark):
    km = one(spark, geo.haversine_km(F.lit(34.05), F.lit(-118.24), F.lit(37.77), F.lit(-122.42)))
    assert 550 < km < 570
    assert one(spark, geo.address_key(F.lit(" 1 Main  St ,Irvine,CA "))) == "1 main st, irvine, ca"
    assert one(spark, geo.state_abbr(F.lit("new  york"))) == "NY"
    assert one(spark, geo.with_state(F.lit("1 Main St, Irvine, USA"), F.lit("CA"))) == "1 Main St, Irvine, CA, USA"
    assert one(spark, geo.with_state(F.lit("Irvine, CA 92602, USA"), F.lit("NV"))) == "Irvine, CA 92602, USA"
    assert one(spark, geo.city_of(F.lit("Hall, 1 Main St, Irvine, CA 92602, USA"))) == "Irvine"
    assert one(spark, geo.postal_address(F.lit("1 Main St, Irvine"), F.lit("irvine"), F.lit("CA"), F.lit(None).cast("string"))) == "1 Main St, Irvine, CA"
    assert one(spark, geo.place_name(F.lit("Irvine city"))) == "Irvine"
    assert tuple(one(spark, geo.valid_coordinates(F.lit("91"), F.lit("0")))) == (None, None)
    assert one(spark, geo.platform_name(F.lit("meetup-la"), {"meetup": "Meetup"})) == "Meetup"


def test_keys(spark):
    assert one(spark, keys.content_hash(F.lit('{"b":1,"a":{"d":2,"c":3}}'))) == one(spark, keys.content_hash(F.lit('{"a":{"c":3,"d":2},"b":1}')))
    first = one(spark, keys.event_id(F.lit("2026-10-01 00:00:00").cast("timestamp"), F.lit(2), F.lit(10)))
    assert first < one(spark, keys.event_id(F.lit("2026-10-01 00:00:00").cast("timestamp"), F.lit(10), F.lit(1)))


def test_within_km_is_the_haversine_at_any_point(spark):
    places = [(33.0, -118.0), (33.2248, -118.0), (33.22483, -118.0), (33.3, -118.01), (90.0, 0.0), (89.9, 170.0), (-89.95, 10.0), (-90.0, 0.0), (10.0, 179.95), (10.0, -179.95), (370.0, -180.05), (1e9 + 10, 1e9), (1e9 + 10.1, 1e9), (None, 1.0), (1.0, None), (float("nan"), 0.0), (float("inf"), 0.0), (0.0, 0.0), (0.0, 0.2248)]
    rows = [(*p, *q) for p in places for q in places]
    # points all around one, a hair to either side of 25 km
    for i in range(200):
        up, east = math.sin(i), math.cos(i)
        d = math.degrees(25 / 6371.0) * (1 + (i - 100) * 1e-12)
        rows.append((33.0, -118.0, 33.0 + d * up, -118.0 + d * east / math.cos(math.radians(33.0 + d * up / 2))))
    pairs = spark.createDataFrame(rows, "a double, b double, c double, d double")
    km = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    near = geo.within_km(geo.on_sphere(F.col("a"), F.col("b")), geo.on_sphere(F.col("c"), F.col("d")), 25, km)
    got = pairs.select(F.coalesce(near, F.lit(False)).alias("got"), F.coalesce(km <= 25, F.lit(False)).alias("want")).collect()
    assert all(r.got == r.want for r in got) and 20 < sum(r.got for r in got) < len(got)


def test_round_half_up_is_that_of_doubles(spark):
    # the product with a million decides, as in SQL on doubles
    values = [0.0, 0.5e-6, 1.4999999e-6, 1.5e-6, 2.5e-6, 24.9999995, 12.3456784999, 1.0000005, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in frame.select(geo.round_half_up(F.col("v"), 6)).collect()]
    want = [None if v is None else math.floor(v * 1e6) / 1e6 if v * 1e6 - math.floor(v * 1e6) < 0.5 else (math.floor(v * 1e6) + 1) / 1e6 for v in values]
    assert got == want
