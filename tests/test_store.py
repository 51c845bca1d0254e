"""Runs over the split store against runs over whole tables."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from evlake.operators import versions
from evlake.plans import run as daily
from evlake.plans.store import Store
from evlake.sources import ics

from .test_run import setup

DAYS = [
    # day of October; (source, uid, title, start, url) of what each feed lists
    (1, [("a", 1, "AI one", "20261001T180000Z", ""), ("a", 2, "AI two", "20261002T180000Z", "https://e/2"), ("a", 3, "AI three", "20261014T180000Z", ""), ("b", 4, "AI four", "20261020T180000Z", "")]),
    (6, [("a", 3, "AI three again", "20261014T180000Z", ""), ("b", 4, "AI four", "20261020T180000Z", ""), ("b", 5, "Talk five", "20261016T180000Z", "")]),
    (7, [("a", 1, "AI one, moved on", "20261001T180000Z", ""), ("a", 3, "AI three again", "20261014T180000Z", ""), ("b", 9, "AI two elsewhere", "20261002T190000Z", "https://e/2")]),
    (8, [("a", 2, "AI two", "20261002T180000Z", "https://e/2"), ("b", 5, "Talk five", "20261016T180000Z", "")]),
]


def records(spark, day, rows):
    text = lambda own: "\n".join(["BEGIN:VCALENDAR", *(f"BEGIN:VEVENT\nUID:{u}\nSUMMARY:{t}\nDTSTART:{s}\nGEO:34.05;-118.24\nLOCATION:Hall\n" + (f"URL:{url}\n" if url else "") + "END:VEVENT" for _, u, t, s, url in own), "END:VCALENDAR"])
    feeds = [(s, text([r for r in rows if r[0] == s]), dt.datetime(2026, 10, day)) for s in sorted({r[0] for r in rows})]
    return ics.read_ics(spark.createDataFrame(feeds, "source_id string, body string, fetched_at timestamp")).drop("pos")


def rows_of(table, names):
    return sorted(map(repr, table.select(*names).collect()))


@pytest.fixture()
def both(spark, tmp_path):
    state, reference = setup(spark)
    stored = dataclasses.replace(reference, raw_path=str(tmp_path / "raw"), hash_path=str(tmp_path / "hashes"))
    return state, reference, stored, Store(spark, str(tmp_path / "state"), state)


def test_split_state_equals_whole_tables(spark, tmp_path, both):
    state, reference, stored, store = both
    empty, before, closed_rows = state, {}, []
    for k, (day, rows) in enumerate(DAYS):
        now, incoming = dt.datetime(2026, 10, day), records(spark, day, rows)
        whole = day == 7  # the other days end after ingesting, which is where closed events come in

        def step(s, own, folder):
            if whole:  # noqa: B023
                return daily.run(s, incoming, ics.parse_ics, own, now, f"r{k}", str(tmp_path / folder))[0]  # noqa: B023
            return daily.ingest(s, incoming, ics.parse_ics, own, now, f"r{k}")[0]  # noqa: B023

        state = step(state, reference, "one")
        assert store.apply(f"r{k}", now, lambda s: step(s, stored, "two"))  # noqa: B023
        assert not store.apply(f"r{k}", now, lambda s: pytest.fail("done before"))
        for name in ("events", "links", "members", "aliases", "runs"):
            names = getattr(empty, name).columns
            assert rows_of(store.whole(name), names) == rows_of(getattr(state, name), names), (day, name)
        kept = store.state()
        closed_rows.append(kept.closed.events.count())
        assert kept.events.where(daily.is_closed(F.lit(now).cast("timestamp"))).count() == 0
        # what earlier runs closed lies where it lay
        value = versions.current(spark, store.path)[1]
        assert set(before) <= set(value.get("closed_events", []))
        before = value.get("closed_events", [])
    assert closed_rows == [0, 2, 2, 2] and value["reopened"]


def test_a_run_that_breaks_off_is_tried_again(spark, tmp_path, both):
    state, reference, stored, store = both
    now = dt.datetime(2026, 10, 1)
    step = lambda s: daily.ingest(s, records(spark, 1, DAYS[0][1]), ics.parse_ics, stored, now, "r0")[0]

    def breaks(s):
        step(s)
        raise OSError("lost")

    with pytest.raises(OSError):
        store.apply("r0", now, breaks)
    assert store.whole("events").count() == 0 and store.apply("r0", now, step)
    whole, _, _ = daily.ingest(state, records(spark, 1, DAYS[0][1]), ics.parse_ics, reference, now, "r0")
    for name in ("events", "links", "runs"):
        names = getattr(state, name).columns
        assert rows_of(store.whole(name), names) == rows_of(getattr(whole, name), names)
    assert sorted(r.native_id for r in spark.read.parquet(stored.raw_path).collect()) == ["1", "2", "3", "4"]
