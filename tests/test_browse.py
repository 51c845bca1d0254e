"""Pages of a ranked table against pages of a sorted one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from evlake.operators import browse

ROWS = "event_id string, start_utc timestamp, title string"


def test_ranked_pages_equal_sorted_ones(spark, tmp_path):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"e{i:04d}", rng.choice([None, dt.datetime(2026, 1, 1 + rng.randrange(9))]), f"t{i}") for i in range(1234)], ROWS)
    order = [F.desc("start_utc"), "event_id"]
    ranked = browse.Ranked.write(rows, order, str(tmp_path / "r"), 16)
    columns = [*rows.columns, "page", "pages", "first", "last", "matched"]
    for size, number in (("25", 1), ("25", 7), ("10", 124), ("25", 50), ("50", 999), ("all", 1), ("what", 0)):
        assert ranked.page(size, number).select(columns).collect() == browse.page(rows, order, size, number).select(columns).collect(), (size, number)
    assert [r.place for r in ranked.between(600, 640).collect()] == list(range(600, 641))
    assert ranked.between(1235, 1300).count() == 0
    # a deep page opens as few files as the first
    assert max(len(ranked.page("25", k).inputFiles()) for k in range(1, 51)) <= 2


def test_ranked_nothing_and_ranked_again(spark, tmp_path):
    path = str(tmp_path / "r")
    none = browse.Ranked.write(spark.createDataFrame([], ROWS), ["start_utc", "event_id"], path)
    assert none.page("25", 3).count() == 0
    one = spark.createDataFrame([("a", None, "t")], ROWS)
    assert [(r.event_id, r.place, r.pages) for r in browse.Ranked.write(one, ["event_id"], path).page().collect()] == [("a", 1, 1)]
