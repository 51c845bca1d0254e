"""The state of daily runs in a folder: open events are rewritten by each run, closed ones are left where they lie."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import versions
from ..operators.storage import discard, written
from . import run as daily
from .run import SPLIT

class Store:
    """Tables of a State under path, by versions: a run's tables count when its version is committed.

    Open rows are one folder for each version. Rows that close are appended once, and stay; where a closed
    event is touched again, (event_id, closed_in) is written down, which hides its closed rows, and the
    event is an open one. Runs are appended. So what a run writes follows the open events and the day's
    changes, not the history. A run finds its records' changes by the folders of Reference, raw_path and
    hash_path, which a run that is tried again overwrites; the version comes last.
    """

    def __init__(self, spark: SparkSession, path: str, empty: daily.State) -> None:
        self.spark, self.path, self.empty = spark, path, empty

    def _read(self, names: list[str], schema: T.StructType) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{n}") for n in names]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _closed(self, value: dict, name: str) -> DataFrame:
        schema = T.StructType([*getattr(self.empty, name).schema.fields, T.StructField("closed_in", T.LongType())])
        back = self._read(value.get("reopened", []), T.StructType([T.StructField("event_id", T.StringType()), T.StructField("closed_in", T.LongType())]))
        rows = self._read(value.get(f"closed_{name}", []), schema)
        return rows.join(back, ["event_id", "closed_in"], "left_anti") if value.get("reopened") else rows

    def state(self) -> daily.State:
        """The last committed state: open rows, with the closed ones beside them."""
        value = versions.current(self.spark, self.path)[1]
        rows = {n: self._read([value[n]] if n in value else [], getattr(self.empty, n).schema) for n in (*SPLIT, "aliases")}
        runs = self._read(value.get("runs", []), self.empty.runs.schema)
        return daily.State(rows["events"], rows["links"], self.empty.raw, runs, rows["members"], rows["aliases"], daily.Closed(*[self._closed(value, n).select(*getattr(self.empty, n).columns, "closed_in") for n in SPLIT]))

    def whole(self, name: str) -> DataFrame:
        """All rows of a table, open and closed."""
        state = self.state()
        return getattr(state, name).unionByName(getattr(state.closed, name).drop("closed_in")) if name in SPLIT else getattr(state, name)

    def done(self, run_id: str) -> bool:
        return run_id in versions.current(self.spark, self.path)[1].get("run_ids", [])

    def save(self, state: daily.State, run_id: str, now: object) -> None:
        """Commits what a run made of state(): the run's rows of runs, the open rows, and those that have closed."""
        number, value = versions.current(self.spark, self.path)
        new = dict(value)
        key = f"v{number + 1:06d}-{uuid.uuid4().hex[:8]}"

        def put(rows: DataFrame, name: str) -> str:
            rows.write.parquet(f"{self.path}/{key}/{name}")
            return f"{key}/{name}"

        closing = written(state.events.where(daily.is_closed(F.lit(now).cast("timestamp"))).select("event_id"), "closing")
        some = not closing.isEmpty()
        for name in SPLIT:
            rows = getattr(state, name)
            new[name] = put(rows.join(closing, "event_id", "left_anti").select(*rows.columns), name)
            if some:
                new[f"closed_{name}"] = [*value.get(f"closed_{name}", []), put(rows.join(closing, "event_id", "left_semi").select(*rows.columns).withColumn("closed_in", F.lit(number + 1).cast("long")), f"closed_{name}")]
        new["aliases"] = put(state.aliases, "aliases")
        new["runs"] = [*value.get("runs", []), put(state.runs.where(F.col("run_id") == run_id), "runs")]
        if state.reopened is not None and not state.reopened.isEmpty():
            new["reopened"] = [*value.get("reopened", []), put(state.reopened, "reopened")]
        # the run's own number stays, so that one that is tried again is known
        new["run_ids"] = [*value.get("run_ids", []), run_id][-versions.KEPT :]
        new["before"] = [value[n] for n in (*SPLIT, "aliases") if n in value]
        versions.commit(self.spark, self.path, number, new)
        for name in value.get("before", []):  # open rows of two versions ago
            discard(self.spark, f"{self.path}/{name}")

    def apply(self, run_id: str, now: object, step: Callable[[daily.State], daily.State]) -> bool:
        """step() of the stored state, committed once for each run_id; False if that was done before."""
        if self.done(run_id):
            return False
        self.save(step(self.state()), run_id, now)
        return True
