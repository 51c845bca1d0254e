"""The incremental steps as streams: ingest, change detection, source health, daily counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import health

if TYPE_CHECKING:
    from ..plans.run import State
    from ..plans.store import Store

#: Rows that a stateful operator gives out at a time.
_CHUNK = 10_000

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ingest(spark: SparkSession, landing: str, schema: str, checkpoint: str, ingest: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Runs ingest(batch, run_id) over the new files of a folder, then stops. A batch that is tried again has the same run_id."""
    rows = spark.readStream.schema(schema).parquet(landing)
    return rows.writeStream.foreachBatch(lambda batch, number: ingest(batch, f"stream-{number:012d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_runs(spark: SparkSession, landing: str, schema: str, checkpoint: str, store: Store, step: Callable[[State, DataFrame, str], State], now: Callable[[str], datetime], files: int | None = None) -> StreamingQuery:
    """Each batch of a folder's new files as a run over a store: step(state, batch, run_id), committed once, however often the batch comes.

    now(run_id) is the run's moment; files are a batch's at most.
    """
    rows = spark.readStream.schema(schema)
    rows = (rows.option("maxFilesPerTrigger", files) if files else rows).parquet(landing)

    def run(batch: DataFrame, number: int) -> None:
        run_id = f"stream-{number:012d}"
        store.apply(run_id, now(run_id), lambda state: step(state, batch, run_id))

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _LastHash(StatefulProcessor):
    """Passes a key's records whose content differs from the record before.

    Of a key's records it holds a time and a number each, 16 bytes, and each different content once.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        times, numbers, known = [], [], {}
        for part in rows:
            times.append(part["fetched_at"].to_numpy("datetime64[ns]"))
            numbers.append(np.fromiter((known.setdefault(h, len(known)) for h in part["content_hash"]), np.int64, len(part)))
        at, number = np.concatenate(times), np.concatenate(numbers)
        names = np.array(list(known), object)
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=lambda i: names[i] or "")] = np.arange(len(names))
        order = np.lexsort((rank[number], at))
        at, number = at[order], number[order]
        before = self.last.get()  # one call for each key, where exists() would be two more
        new = np.ones(len(number), bool)
        new[1:] = number[1:] != number[:-1]
        new[0] = before is None or names[number[0]] != before[0]
        self.last.update((names[number[-1]],))
        changed = np.flatnonzero(new)
        for k in range(0, len(changed), _CHUNK):
            part = changed[k : k + _CHUNK]
            yield pd.DataFrame({"source_id": key[0], "native_id": key[1], "content_hash": names[number[part]], "fetched_at": at[part]})

    def close(self) -> None:
        pass


def stream_changes(raw: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """Records of a stream raw(source_id, native_id, content_hash, fetched_at) that differ from their key's last; a return to old content counts.

    With keep, a key that brings nothing for so long is forgotten, and new when it comes again.
    """
    columns = raw.select("source_id", "native_id", "content_hash", "fetched_at")
    processor = _LastHash(int(keep.total_seconds() * 1000) if keep else None)
    return columns.groupBy("source_id", "native_id").transformWithStateInPandas(processor, "source_id string, native_id string, content_hash string, fetched_at timestamp", "Append", "ProcessingTime" if keep else "None")


class _Health(StatefulProcessor):
    """A source's streak of unhealthy runs, and the alerts it raises."""

    def __init__(self, alert_after: int, disable_after: int) -> None:
        self.alert_after, self.disable_after = alert_after, disable_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n long, since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["started_at", "run_id"], kind="stable")
        n, since = self.streak.get() if self.streak.exists() else (0, None)
        out = []
        for row in batch.itertuples():
            action = None
            if row.healthy:
                action = "resolve" if n >= min(self.alert_after, self.disable_after) else None
                n, since = 0, None
            else:
                n, since = n + 1, since or row.started_at
                action = "alert" if n in (self.alert_after, self.disable_after) else None
            state = "healthy" if row.healthy else "disabled" if n >= self.disable_after else "unhealthy"
            out.append((key[0], row.run_id, row.started_at, n, since, state, action))
        self.streak.update((n, since))
        yield pd.DataFrame(out, columns=["source_id", "run_id", "started_at", "unhealthy_runs", "since", "state", "action"])

    def close(self) -> None:
        pass


def stream_health(judged: DataFrame, alert_after: int, disable_after: int) -> DataFrame:
    """The states of health.states() for a stream judged(source_id, run_id, started_at, healthy) whose runs come in order."""
    schema = "source_id string, run_id string, started_at timestamp, unhealthy_runs long, since timestamp, state string, action string"
    columns = judged.select("source_id", "run_id", "started_at", "healthy")
    return columns.groupBy("source_id").transformWithStateInPandas(_Health(alert_after, disable_after), schema, "Append", "None")


class _RunHealth(StatefulProcessor):
    """A source's trailing ok-runs and its streak: verdict and state of each run, as the batch form gives them.

    The ok-runs of the window are all that is kept of the past; older ones go when a run comes.
    """

    def __init__(self, levels: dict[str, float], alert_after: int, disable_after: int) -> None:
        self.levels, self.alert_after, self.disable_after = levels, alert_after, disable_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ok_runs = handle.getListState("ok_runs", "started_at timestamp, fetched long")
        self.streak = handle.getValueState("streak", "n long, since timestamp")

    def _reasons(self, row, typical: float | None, n_history: int) -> list[str]:
        out = []
        if row.status != "ok":
            out.append(f"fetch failed: {row.status if pd.isna(row.error) else row.error}")
        attempted = row.parsed + row.parse_errors
        if attempted and row.parse_errors / attempted > self.levels["max_errors"]:
            out.append(f"{row.parse_errors} of {attempted} changed records failed to parse")
        if row.status == "ok" and n_history >= self.levels["min_history"] and typical and row.fetched < self.levels["min_yield"] * typical:
            out.append(f"fetched {row.fetched} records, typical is {str(typical).removesuffix('.0')}")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch[batch["status"] != "disabled"].sort_values(["started_at", "run_id"], kind="stable")
        history = [(pd.Timestamp(t), n) for t, n in self.ok_runs.get()]
        n, since = self.streak.get() if self.streak.exists() else (0, None)
        window, out = pd.Timedelta(days=self.levels["window_days"]), []
        for row in batch.itertuples():
            history = [h for h in history if h[0] >= row.started_at - window]
            earlier = [fetched for at, fetched in history if at < row.started_at]
            typical = float(pd.Series(earlier).median()) if earlier else None
            reasons = self._reasons(row, typical, len(earlier))
            action = None
            if not reasons:
                action = "resolve" if n >= min(self.alert_after, self.disable_after) else None
                n, since = 0, None
            else:
                n, since = n + 1, since or row.started_at
                action = "alert" if n in (self.alert_after, self.disable_after) else None
            state = "healthy" if not reasons else "disabled" if n >= self.disable_after else "unhealthy"
            out.append((key[0], row.run_id, row.started_at, typical, len(earlier), reasons, n, since, state, action))
            if row.status == "ok":
                history.append((row.started_at, int(row.fetched)))
        self.ok_runs.put([(at.to_pydatetime(), fetched) for at, fetched in history])
        self.streak.update((n, since))
        if out:
            yield pd.DataFrame(out, columns=["source_id", "run_id", "started_at", "typical", "n_history", "reasons", "unhealthy_runs", "since", "state", "action"])

    def close(self) -> None:
        pass


def stream_run_health(runs: DataFrame, min_yield: float = health.MIN_YIELD_RATIO, window_days: int = health.WINDOW_DAYS, min_history: int = health.MIN_HISTORY_RUNS, max_errors: float = health.MAX_PARSE_ERROR_RATIO, alert_after: int = health.ALERT_AFTER, disable_after: int = health.DISABLE_AFTER) -> DataFrame:
    """health.verdicts() and health.states() of a stream of run rows that nobody has judged; a source's runs come in order.

    Runs of status disabled are passed over.
    """
    levels = {"min_yield": min_yield, "window_days": window_days, "min_history": min_history, "max_errors": max_errors}
    schema = "source_id string, run_id string, started_at timestamp, typical double, n_history long, reasons array<string>, unhealthy_runs long, since timestamp, state string, action string"
    columns = runs.select("source_id", "run_id", F.col("started_at").cast("timestamp").alias("started_at"), "status", F.col("error").cast("string").alias("error"), *[F.col(c).cast("long").alias(c) for c in ("fetched", "parsed", "parse_errors")])
    return columns.groupBy("source_id").transformWithStateInPandas(_RunHealth(levels, alert_after, disable_after), schema, "Append", "None")


def stream_daily_new(members: DataFrame) -> DataFrame:
    """(profile_id, day, n) of a stream of memberships; a day is given out once no row of it is expected, and rows a day late are dropped."""
    days = members.withWatermark("first_seen", "1 day").groupBy(F.window("first_seen", "1 day"), "profile_id").agg(F.count("*").alias("n"))
    return days.select("profile_id", F.col("window.start").alias("day"), "n")
