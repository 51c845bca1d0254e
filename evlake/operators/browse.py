"""Reading a feed: search, order under headings, pages and groups."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import area_of_event, platform_of
from ..functions.times import day_heading
from . import versions

PAGE_SIZES = {"10": 10, "25": 25, "50": 50, "all": None}
LAST_HEADINGS = {"Online": 1, "Location not listed": 2}


def search(rows: DataFrame, query: str, columns: list[str], kind: str | None = None) -> DataFrame:
    """Rows that contain every word of query in some of columns, and are of a kind."""
    text = F.lower(F.concat_ws(" ", *columns))
    for word in query.lower().split():
        rows = rows.where(F.contains(text, F.lit(word)))
    return rows.where(F.array_contains("kinds", kind)) if kind else rows


def heading_order(heading: Column, *then: str) -> list[Column]:
    """Alphabetical whatever the case, the two general headings last, then as given."""
    rank = F.lit(0)
    for name, place in LAST_HEADINGS.items():
        rank = F.when(heading == name, place).otherwise(rank)
    return [rank, F.lower(heading), *map(F.col, then)]


def _bounds(matched: int, n: int | None, number: int) -> tuple[int, int, int, int]:
    """(pages, number, rows before the page, rows to its end) of the page nearest to number."""
    pages = max(1, -(-matched // n)) if n else 1
    number = min(max(number, 1), pages)
    return (pages, number, (number - 1) * n, min(number * n, matched)) if n else (pages, number, 0, matched)


def _described(pages: int, number: int, first: int, last: int, matched: int) -> dict[str, Column]:
    return {"page": F.lit(number), "pages": F.lit(pages), "first": F.lit(first + 1 if matched else 0), "last": F.lit(last), "matched": F.lit(matched)}


def page(rows: DataFrame, order: list[Column | str], size: str = "25", number: int = 1) -> DataFrame:
    """The rows of a page, with page, pages, first, last and matched; an unknown size is 25, and a page out of range the nearest.

    Right for the first pages: Spark keeps all rows before the page too. Deep pages are read from Ranked.
    """
    n, matched = PAGE_SIZES.get(size, 25), rows.count()
    pages, number, first, last = _bounds(matched, n, number)
    shown = rows.orderBy(*order)
    if n:
        shown = shown.offset(first).limit(n)
    return shown.withColumns(_described(pages, number, first, last, matched))


class Ranked:
    """Rows in an order, written once with their places, so that any page opens only the files it lies in.

    Sorted ranges are folders of their own, each row with its place in its range; the version lists how
    many rows each has. What a page costs depends on its size alone, not on how deep it is.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        value = versions.current(spark, path)[1]
        self.spark, self.path, self.schema = spark, f"{path}/{value['folder']}", value["schema"]
        self.parts, self.starts = value["parts"], [0, *itertools.accumulate(value["rows"])]

    @classmethod
    def write(cls, rows: DataFrame, order: list[Column | str], path: str, parts: int | None = None) -> Ranked:
        """Ranks rows by order, which should end in a key, under path; readers see it when it is whole. parts are the ranges, as many as Spark's shuffles have by default."""
        spark = rows.sparkSession
        number, _ = versions.current(spark, path)
        ranges = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
        inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's place in its partition
        placed = ranges.sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": inside})
        folder = f"ranked-{number + 1:06d}"
        placed.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/{folder}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
        # one row for each range
        counts = spark.read.schema(schema).parquet(f"{path}/{folder}").groupBy("_part").count().orderBy("_part").collect()
        versions.commit(spark, path, number, {"folder": folder, "schema": schema, "parts": [r[0] for r in counts], "rows": [r[1] for r in counts]})
        return cls(spark, path)

    def between(self, first: int, last: int) -> DataFrame:
        """Rows of places first to last, counted from 1, with place, in order."""
        first, last = max(first, 1), min(last, self.starts[-1])
        some = [k for k in range(len(self.parts)) if self.starts[k] < last and self.starts[k + 1] >= first] if first <= last else []
        rows = None
        for k in some:
            own = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/_part={self.parts[k]}")
            own = own.where(F.col("_at").between(first - 1 - self.starts[k], last - 1 - self.starts[k])).withColumn("place", F.col("_at") + 1 + self.starts[k])
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            rows = self.spark.createDataFrame([], self.schema).withColumn("place", F.lit(None).cast("long"))
        return rows.orderBy("place").drop("_part", "_at")

    def page(self, size: str = "25", number: int = 1) -> DataFrame:
        """The same rows and columns as page() of the whole table, and place."""
        matched, n = self.starts[-1], PAGE_SIZES.get(size, 25)
        pages, number, first, last = _bounds(matched, n, number)
        return self.between(first + 1, last).withColumns(_described(pages, number, first, last, matched))


def after(rows: DataFrame, start, event_id: str, n: int) -> DataFrame:
    """The next n rows in feed order after a row; deep pages cost no more than the first."""
    later = (F.col("start_utc") > start) | ((F.col("start_utc") == start) & (F.col("event_id") > event_id))
    return rows.where(later).orderBy("start_utc", "event_id").limit(n)


def groups(rows: DataFrame, heading: Column, order: list[str]) -> DataFrame:
    """(heading, n): counts under headings that differ by more than case, shown as first written in order."""
    return rows.groupBy(F.lower(heading).alias("_key")).agg(F.min_by(heading, F.struct(*order)).alias("heading"), F.count("*").alias("n")).select("heading", "n")


def placed_in_groups(rows: DataFrame, heading: Column, order: list[str]) -> DataFrame:
    """rows with place, from 1, under their heading: the members of each group in order, a row each."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lower(heading)).orderBy(*order)))


def page_groups(shown: DataFrame, member: str, order: list[str]) -> DataFrame:
    """(heading, members): what a page of browse() shows under each heading, as first written; only for pages of a fixed size."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(member).alias("_member")))), lambda m: m["_member"])
    return shown.groupBy(F.lower("heading").alias("_key")).agg(F.min_by("heading", F.struct(*order)).alias("heading"), listed.alias("members")).drop("_key")


def headings(sort: str, prefixes: dict[str, str]) -> Column:
    """The heading of a feed row by date, city or source."""
    if sort == "city":
        return area_of_event(F.col("attendance_mode"), F.col("address"), F.col("area"))
    if sort == "source":
        return platform_of(F.col("source_ids"), prefixes)
    return day_heading(F.col("start_utc"), F.col("tz"))


def browse(feed: DataFrame, query: str = "", kind: str | None = None, sort: str = "date", size: str = "25", number: int = 1, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A page of a feed's rows: those that contain every word, of a kind, in the order of sort, with heading and the summary counts.

    Adds heading, page, pages, first, last, matched (rows that the search leaves) and total (rows of the
    feed). By date the order is the feed's; by city or source headings come alphabetically, the general
    ones last, and rows by start under each.
    """
    found = search(feed, query, ["title", "venue", "address", "organizer"], kind).withColumn("heading", headings(sort, prefixes or {}))
    order = ["start_utc", "event_id"] if sort == "date" else heading_order(F.col("heading"), "start_utc", "event_id")
    return page(found, order, size, number).withColumn("total", F.lit(feed.count()))
