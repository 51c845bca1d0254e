import datetime as dt

from pyspark.sql import functions as F

from evlake.sources import gazetteer, ics, jsonld, listings, pages, robots, rules

ICS = "\r\n".join([
    "BEGIN:VCALENDAR", "X-WR-TIMEZONE:America/Los_Angeles",
    "BEGIN:VTIMEZONE", "TZID:Own Pacific", "BEGIN:STANDARD", "DTSTART:20071104T020000", "RRULE:FREQ=YEARLY;BYMONTH=11;BYDAY=1SU", "TZOFFSETFROM:-0700", "TZOFFSETTO:-0800", "END:STANDARD",
    "BEGIN:DAYLIGHT", "DTSTART:20070311T020000", "RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=2SU", "TZOFFSETFROM:-0800", "TZOFFSETTO:-0700", "END:DAYLIGHT", "END:VTIMEZONE",
    "BEGIN:VEVENT", "UID:a@x", "DTSTAMP:20260101T000000Z", "SEQUENCE:{n}", "SUMMARY:AI\\, Night", "DTSTART:20261014T180000Z", "DTEND:20261014T200000Z", "LOCATION:https://us02.zoom.us/j/1", "DESCRIPTION:Long ", " line https://a.test/e.", "GEO:34.05;-118.24", "END:VEVENT",
    "BEGIN:VEVENT", "UID:b@x", "SUMMARY:Floating", "DTSTART:20261014T180000", "DURATION:PT1H30M", "LOCATION:Hall", "STATUS:CANCELLED", "END:VEVENT",
    "BEGIN:VEVENT", "UID:c@x", "SUMMARY:Custom", "DTSTART;TZID=Own Pacific:20261014T180000", "DTEND;TZID=Own Pacific:20261014T170000", "END:VEVENT",
    "BEGIN:VEVENT", "UID:d@x", "DTSTART;VALUE=DATE:20261014", "END:VEVENT",
    "BEGIN:VEVENT", "SUMMARY:All day", "DTSTART;VALUE=DATE:20261014", "RECURRENCE-ID:20261014T000000Z", "END:VEVENT", "END:VCALENDAR"])


def read(spark, n=1):
    feeds = spark.createDataFrame([("s", ICS.replace("{n}", str(n)), dt.datetime(2026, 1, 1))], "source_id string, body string, fetched_at timestamp")
    return ics.read_ics(feeds)


def test_calendar_feed(spark):
    raw = read(spark)
    assert {r.native_id: r.content_hash for r in raw.collect()} == {r.native_id: r.content_hash for r in read(spark, 2).collect()}
    got = {r.native_id: r for r in ics.parse_ics(raw).withColumn("t", F.date_format("start_utc", "MM-dd HH:mm")).withColumn("u", F.date_format("end_utc", "MM-dd HH:mm")).collect()}
    a, b, c, d = (got[k] for k in ("a@x", "b@x", "c@x", "d@x"))
    assert (a.title, a.t, a.u, a.attendance_mode, a.url, a.lat, a.address) == ("AI, Night", "10-14 18:00", "10-14 20:00", "online", "https://us02.zoom.us/j/1", 34.05, None)
    assert a.description == "Long line https://a.test/e." and a.tz == "America/Los_Angeles"
    assert (b.t, b.u, b.status, b.attendance_mode, b.address) == ("10-15 01:00", "10-15 02:30", "cancelled", "in_person", "Hall")
    assert (c.t, c.u) == ("10-15 01:00", None)
    assert d.reason == "no summary"
    (rest,) = [r for k, r in got.items() if k.startswith("sha256:")]
    assert rest.t == "10-14 07:00" and rest.native_id.endswith("#2026-10-14T00:00:00") and rest.reason is None


PAGE = """<html><script type="application/ld+json;charset=utf-8"><!-- {"@context":"x","@graph":[{"@type":"BusinessEvent","name":"Robots &amp; us","startDate":"2026-10-14T18:00:00-07:00","endDate":"2026-10-14T17:00:00-07:00",
"url":"/e/1?utm_source=q","location":[{"@type":"VirtualLocation","url":"https://z"},{"@type":"Place","name":"Hall","address":{"streetAddress":"1 Main St","addressLocality":"Irvine","addressRegion":"CA"},"geo":{"latitude":"33.6","longitude":-117.8}}],
"organizer":[{"@type":"Person","name":"P"},{"@type":"Organization","name":"Org"}],"eventStatus":"https://schema.org/EventCancelled","subEvent":{"@type":"Event","name":"inner"}},
{"@type":"ItemList","itemListElement":[{"item":{"url":"/e/2","name":"two"}},"/e/3"]}]} --></script><script type="application/ld+json">{broken</script><a href="/x">1</a><a href='mailto:q'>2</a><a href="/x#t">3</a></html>"""


def test_structured_pages(spark):
    table = spark.createDataFrame([("https://a.test/e/1", PAGE), ("https://a.test/none", "<p>"), ("https://a.test/null", None)], "url string, html string")
    found = jsonld.nodes(table)
    assert [r.node for r in jsonld.event_nodes(found).select(F.get_json_object("node", "$.name").alias("node")).collect()] == ["Robots &amp; us"]
    assert sorted((r.url, r.item is None) for r in jsonld.item_list(found).collect()) == [("https://a.test/e/2", False), ("https://a.test/e/3", True)]
    draft = jsonld.parse_event_pages(jsonld.event_nodes(found).withColumn("source_id", F.lit("s")), zone="America/Los_Angeles").first()
    assert (draft.title, draft.end_utc, draft.venue, draft.address, draft.lat, draft.attendance_mode, draft.status, draft.organizer, draft.tz) == ("Robots & us", None, "Hall", "1 Main St, Irvine, CA", 33.6, "hybrid", "cancelled", "Org", "America/Los_Angeles")
    assert [(r.pos, r.url) for r in pages.page_links(table).orderBy("pos").collect()] == [(0, "https://a.test/x"), (2, "https://a.test/x#t")]


def test_frontier_and_refresh(spark):
    links = spark.createDataFrame([("s", "https://a.test/", 0, i, f"https://a.test/e/{i % 3}?utm_x=1#f") for i in range(6)] + [("s", "https://a.test/", 0, 9, "https://a.test/about")], "source_id string, page string, page_ord int, pos int, url string")
    assert [r.url for r in pages.frontier(links, "/e/", 2).orderBy("place").collect()] == ["https://a.test/e/0", "https://a.test/e/1"]
    fetches = spark.createDataFrame([("a", False)] * 3 + [("b", False)] * 2 + [("c", False)] * 3 + [("c", True)], "source_id string, ok boolean")
    assert [r.source_id for r in pages.failed_sources(fetches).collect()] == ["a"]


def test_robots(spark):
    body = "User-agent: other\nUser-agent: bot # us\nDisallow:\nUser-agent: *\nDisallow: /\n\nUser-agent: bot\nDisallow: /p*x$\nAllow: /p/ax\nCrawl-delay: 3"
    rows = robots.read_robots(spark.createDataFrame([("a.test", body)], "host string, body string"), "bot/1.0")
    assert sorted((r.pattern, r.allow, r.delay) for r in rows.collect()) == [("/p*x$", False, 3.0), ("/p/ax", True, 3.0)]
    urls = spark.createDataFrame([("https://a.test/p/bx",), ("https://a.test/p/ax",), ("https://a.test/p/bxy",), ("https://b.test/p/bx",), ("https://c.test/",)], "url string")
    got = {r.url: r.allowed for r in robots.crawl_decisions(urls, rows, spark.createDataFrame([("c.test",)], "host string")).collect()}
    assert got == {"https://a.test/p/bx": False, "https://a.test/p/ax": True, "https://a.test/p/bxy": True, "https://b.test/p/bx": True, "https://c.test/": False}


def test_listings(spark):
    body = '{"data":{"eventSearch":{"edges":[{"node":{"id":"1","title":"A","dateTime":"2026-10-14T18:00","eventType":"PHYSICAL","status":"CANCELLED","eventUrl":"https://m/1?ref=q","rsvps":{"totalCount":5},"venue":{"address":"1 St","city":"LA","lat":34,"lon":-118},"group":{"name":"G","timezone":"America/Los_Angeles"}}},{"node":{"id":"1","title":"again"}},{"node":{"id":"2","title":"On","eventType":"ONLINE","dateTime":"2026-10-14T18:00"}}]}}}'
    rows = listings.read_search(spark.createDataFrame([("s", 1, body)], "source_id string, page int, body string"))
    (a,) = listings.parse_search(rows).collect()
    assert (a.native_id, a.title, a.status, a.size_signal, a.address, a.lat, a.url, a.start_utc.hour) == ("1", "A", "cancelled", 5, "1 St, LA", 34.0, "https://m/1", 1)
    organizer = '{"events":[{"id":"7","name":{"text":"N"},"start":{"timezone":"America/New_York","utc":"2026-10-14T18:00:00Z"},"status":"canceled","online_event":false,"capacity":9,"url":"https://e/7","venue":{"name":"V","address":{"city":"C","region":"CA"},"latitude":"1","longitude":"2"}}]}'
    (e,) = listings.parse_organizer(listings.read_organizer(spark.createDataFrame([("s", 1, organizer)], "source_id string, page int, body string"))).collect()
    assert (e.title, e.status, e.size_signal, e.address, e.lat, e.tz) == ("N", "cancelled", 9, "C, CA", 1.0, "America/New_York")
    html = '<script data-page="app" type="application/json">{"props":{"upcomingEvents":[{"id":"9","name":"H","startsAt":"2026-10-14","url":"/h","formatType":"physical","venueAddress":{"city":"C","state":"California","country":"XX"}}]}}</script>'
    good, errors = listings.read_page_data(spark.createDataFrame([("s", "https://p.test/s", html), ("t", "https://p.test/t", "<p>")], "source_id string, page string, html string"))
    (h,) = listings.parse_page_data(good).collect()
    assert (h.kinds, h.address, h.url) == (["hackathon"], "C, CA", "https://p.test/h") and [r.source_id for r in errors.collect()] == ["t"]
    listing = listings.read_listing(spark.createDataFrame([("s", 1, '{"hackathons":[{"id":1,"title":"T","url":"https://h/1?ref=x","organization_name":"Org","registrations_count":40}]}')], "source_id string, page int, body string"))
    drafts = spark.createDataFrame([("s", "https://h/1", ["meetup"], "page", None)], "source_id string, native_id string, kinds array<string>, organizer string, size_signal long")
    d = listings.with_pages(listing, drafts).first()
    assert (d.kinds, d.organizer, d.size_signal) == (["hackathon", "meetup"], "Org", 40)


def test_rules_and_parsers(spark):
    sources = rules.source_table(spark, [("a", "ics", True, 1, [], None, None), ("a", "what", True, 1, [], "nowhere", None)])
    profiles = rules.profile_table(spark, [("p", "r", "none", ["a", "b"], ["c"])])
    found = {(r.subject, r.problem) for r in rules.check_rules(sources, profiles, spark.createDataFrame([("r",)], "region_id string"), spark.createDataFrame([("t",)], "topic_id string"), ["ics"]).collect()}
    assert found == {("a", "repeated source"), ("a", "unknown adapter what"), ("a", "unknown region nowhere"), ("p", "unknown topic none"), ("p", "unknown source b"), ("p", "unknown trusted source c")}
    raw = spark.createDataFrame([("1", "5"), ("2", "x")], "native_id string, payload string")
    got = {r.native_id: (r.size, r.error) for r in rules.parse_each(raw, lambda r: [{"size": int(r["payload"])}], "size long").collect()}
    assert got["1"] == (5, None) and got["2"][1].startswith("ValueError")


def test_gazetteer(spark, tmp_path):
    (tmp_path / "g.txt").write_text("USPS|GEOID|NAME|ALAND|INTPTLAT|INTPTLONG   \nCA|1|Irvine city|5|33.684567|-117.8\nCA|2|Irvine CDP|9|1.5|2.5\n")
    rows = gazetteer.read_gazetteer(spark, str(tmp_path / "g.txt"))
    assert [tuple(r) for r in gazetteer.place_centroids(rows).collect()] == [("CA", "irvine", 1.5, 2.5)]
    assert gazetteer.zip_centroids(rows).count() == 2
