"""The latest content hash of every key, kept by delta files over a bucketed base and merged as it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes, versions
from .storage import discard

BUCKETS = 256
#: Deltas that are read at most; one more, and they are merged.
MAX_DELTAS = 8
#: Deltas become part of the base when they have this share of its rows; before that they are merged with one another.
BASE_SHARE = 0.25


class HashTable:
    """(keys, at, digest) of each key's newest content in a folder of shared storage.

    Rows lie in buckets by a hash of the key. A run appends the hashes of what it found changed as one
    delta; the base is rewritten only when deltas have grown to a part of it, so what is written follows
    the changes. A version lists the files that count: a crash leaves the table as it was. A run that is
    tried again replaces its own delta, and doesn't see it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], at: str = "fetched_at", digest: str = "content_hash", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.at, self.digest = spark, path, keys, at, digest
        self.buckets = versions.current(spark, path)[1].get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, records: DataFrame) -> list[int]:
        """Buckets of these records' keys; as many numbers as there are buckets, at most."""
        return sorted(r.bucket for r in records.select(self._bucket().alias("bucket")).distinct().collect())

    def _rows(self, segments: list[dict], buckets: list[int] | None = None) -> DataFrame | None:
        parts = None
        for s in segments:
            part = self.spark.read.schema(s["schema"]).parquet(f"{self.path}/{s['name']}")
            part = part if buckets is None else part.where(F.col("bucket").isin(buckets))
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def latest(self, buckets: list[int] | None = None, but_run: str | None = None) -> DataFrame | None:
        """The newest row of each key in these buckets, all by default; None if nothing was ever appended. Of equal times the greater digest counts."""
        segments = [s for s in versions.current(self.spark, self.path)[1].get("segments", []) if s["run_id"] != but_run or but_run is None]
        rows = self._rows(segments, buckets)
        return None if rows is None else self._newest(rows).drop("bucket")

    def _newest(self, rows: DataFrame) -> DataFrame:
        # the bucket follows from the key, and keeps the partitioning
        newest = rows.groupBy("bucket", *self.keys).agg(F.max(F.struct(self.at, self.digest)).alias("_n"))
        return newest.select(*self.keys, f"_n.{self.at}", f"_n.{self.digest}", "bucket")

    def detect(self, incoming: DataFrame, run_id: str | None = None) -> DataFrame:
        """incoming with change, as changes.detect_changes() tells it from the whole log; only hashes of the buckets it touches are read."""
        known = self.latest(self.touched(incoming), run_id)
        if known is None:
            known = incoming.select(*self.keys, self.at, self.digest).limit(0)
        return changes.detect_changes(incoming, known, self.keys, self.digest)

    def append(self, changed: DataFrame, run_id: str) -> None:
        """The hashes of a run's new and changed records, as one delta and one commit."""
        number, state = versions.current(self.spark, self.path)
        segments, gone = [s for s in state.get("segments", []) if s["run_id"] != run_id], [s["name"] for s in state.get("segments", []) if s["run_id"] == run_id]
        if sum(s["run_id"] is not None for s in segments) >= MAX_DELTAS:
            segments, merged = self._merged(segments)
            gone += merged
        rows = changed.select(*self.keys, self.at, self.digest).withColumn("bucket", self._bucket())
        segments = [*segments, self._segment(self._newest(rows), "delta", run_id)]
        versions.commit(self.spark, self.path, number, {"buckets": self.buckets, "segments": segments, "gone": gone})
        for name in state.get("gone", []):  # who reads the version before still finds its files
            discard(self.spark, f"{self.path}/{name}")

    def _segment(self, rows: DataFrame, kind: str, run_id: str | None) -> dict:
        name = f"{kind}-{uuid.uuid4().hex}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {"name": name, "kind": kind, "run_id": run_id, "schema": schema, "rows": self.spark.read.schema(schema).parquet(f"{self.path}/{name}").count()}

    def _merged(self, segments: list[dict]) -> tuple[list[dict], list[str]]:
        """Segments with the deltas merged, and the names of those that are left out."""
        base, deltas = [s for s in segments if s["kind"] == "base"], [s for s in segments if s["kind"] != "base"]
        if sum(s["rows"] for s in deltas) >= BASE_SHARE * sum(s["rows"] for s in base):
            return [self._segment(self._newest(self._rows(segments)), "base", None)], [s["name"] for s in segments]
        return [*base, self._segment(self._newest(self._rows(deltas)), "merged", None)], [s["name"] for s in deltas]
