"""Keyed state with event-time timers: steps in time order, visits and repeated keys of a stream.

Rows wait in the state of their key until the watermark has passed them, so what a job writes is final and equals the batch form over the
same rows; rows later than the watermark are dropped. A key that stays idle loses its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from larkspur.functions.render import parse_event_line
from larkspur.operators.dedup import latest_per_key
from larkspur.operators.quality import FAIL, UNIQUE_RULES
from larkspur.operators.reports import event_rows
from larkspur.sources.specs import SourceSpec

STEP_SCHEMA = "query_id STRING, step_no BIGINT, node STRING, ts TIMESTAMP, elapsed_ms BIGINT, step_ms BIGINT"
REPEAT_SCHEMA = "record_key STRING, copies BIGINT, first_seen TIMESTAMP, last_seen TIMESTAMP"


@contextmanager
def keyed_state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers and lists of a key need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _due(micros: int) -> int:
    """The first watermark, in milliseconds, that has passed a time."""
    return -(-micros // 1000)


class StepTimes(StatefulProcessor):
    """Writes each step of a query once all earlier steps are known: its number, and the time since the first and the last step.

    ``waiting`` holds steps the watermark has not passed, ``done`` the first and last written step and their number. One timer waits for
    the earliest step, and is set anew for the next one that is left, so a query is called once per watermark, not once per step. A query that is
    idle for ``idle_ms`` is forgotten; a later step of the same id starts anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts BIGINT, position BIGINT, node STRING")
        self.done = handle.getValueState("done", "first_ts BIGINT, last_ts BIGINT, steps BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for part in rows:
            fresh += zip(_micros(part["ts"]), part["position"].tolist(), part["node"].tolist())
        self.waiting.appendList(fresh)
        if fresh:
            self.handle.registerTimer(_due(min(ts for ts, _, _ in fresh)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in waiting if x[0] <= limit]
        first, last, steps = self.done.get() if self.done.exists() else (None, None, 0)
        out = []
        for ts, _, node in ready:
            if last is None or ts - last > self.idle_ms * 1000:
                first, last, steps = ts, ts, 0
            steps += 1
            out.append((key[0], steps, node, pd.Timestamp(ts, unit="us"), (ts - first) // 1000, (ts - last) // 1000))
            last = ts
        if ready:
            self.waiting.clear()
            if len(ready) < len(waiting):
                self.waiting.put(waiting[len(ready) :])
                self.handle.registerTimer(_due(waiting[len(ready)][0]))
        if last is not None and limit > last + self.idle_ms * 1000:
            self.done.clear()
        elif ready:
            self.done.update((first, last, steps))
            self.handle.registerTimer(_due(last) + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["query_id", "step_no", "node", "ts", "elapsed_ms", "step_ms"])

    def close(self) -> None:
        pass


class RepeatedKeys(StatefulProcessor):
    """Writes a key again whenever the watermark has passed more of its copies; forgets a key that is idle for ``idle_ms``."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "copies BIGINT, first_ts BIGINT, last_ts BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(int(n), a, b) for part in rows for n, a, b in zip(part["n"], _micros(part["first_ts"]), _micros(part["last_ts"]))]
        begin, end = min(a for _, a, _ in parts), max(b for _, _, b in parts)
        copies, first, last = self.seen.get() or (0, begin, end)
        if begin - last > self.idle_ms * 1000:
            copies, first = 0, begin
        before, copies, first, last = copies, copies + sum(n for n, _, _ in parts), min(first, begin), max(last, end)
        self.seen.update((copies, first, last))
        self.handle.registerTimer(_due(last) + self.idle_ms + 1)
        if copies > max(1, before):
            yield pd.DataFrame({"record_key": [key[0]], "copies": [copies], "first_seen": [pd.Timestamp(first, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and timerValues.getCurrentWatermarkInMs() > _due(self.seen.get()[2]) + self.idle_ms:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def step_events(lines: DataFrame) -> DataFrame:
    """``query_id, ts, position, node`` of the event lines (``line``, ``ts``) that parse and name a query."""
    parsed = event_rows(lines, parse_event_line(F.col("line")), ["ts"]).filter(F.col("query_id").isNotNull())
    return parsed.select("query_id", "ts", F.coalesce("elapsed_ms", F.lit(0)).cast("long").alias("position"), F.coalesce("node", F.lit("?")).alias("node"))


def stream_step_times(lines: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", idle_ms: int = 1_800_000) -> StreamingQuery:
    """Each step of a query with its number, ``elapsed_ms`` since the query's first and ``step_ms`` since its previous step.

    Equals :func:`larkspur.operators.visits.step_times` over the same lines, for steps that the watermark (``delay``) has passed. Steps of
    equal time are ordered by the elapsed time they report, then by name. The state of a query holds its waiting steps and
    three numbers, and goes away when the query was idle for ``idle_ms``.
    """
    steps = step_events(lines).withWatermark("ts", delay).groupBy("query_id")
    timed = steps.transformWithStateInPandas(StepTimes(idle_ms), STEP_SCHEMA, "append", "EventTime")
    with keyed_state_store(lines.sparkSession):
        return timed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies per key inside a map task, so a key that most rows share arrives as few rows."""
    for batch in batches:
        part = pa.table({"record_key": batch.column("record_key"), "ts": batch.column("ts"), "n": pa.array([1] * batch.num_rows, pa.int64())})
        sums = part.group_by("record_key").aggregate([("n", "sum"), ("ts", "min"), ("ts", "max")])
        yield from sums.select(["record_key", "n_sum", "ts_min", "ts_max"]).rename_columns(["record_key", "n", "first_ts", "last_ts"]).to_batches()


def stream_uniqueness(records: DataFrame, spec: SourceSpec, ts: str, out: str, checkpoint: str, delay: str = "1 hour", idle_ms: int = 604_800_000) -> StreamingQuery:
    """Watches a source's key over all micro-batches and writes a row each time a key got more copies than one.

    Keys are trimmed; null is no key. ``ts`` is the delivery time; a key that was not delivered for ``idle_ms`` is forgotten, so state
    is bounded by the keys of that time. :func:`uniqueness_violations` turns the rows into violations.
    """
    keyed = records.select(F.trim(F.col(spec.key)).alias("record_key"), F.col(ts).cast("timestamp").alias("ts")).filter("record_key IS NOT NULL")
    counts = keyed.mapInArrow(_counted, "record_key STRING, n BIGINT, first_ts TIMESTAMP, last_ts TIMESTAMP").withWatermark("last_ts", delay)
    repeats = counts.groupBy("record_key").transformWithStateInPandas(RepeatedKeys(idle_ms), REPEAT_SCHEMA, "append", "EventTime")
    with keyed_state_store(records.sparkSession):
        return repeats.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def uniqueness_violations(repeats: DataFrame, spec: SourceSpec) -> DataFrame:
    """``rule_id, severity, record_id, message, copies``: one row per repeated key, as it stands after the last batch."""
    newest = latest_per_key(repeats, ["record_key"], [F.desc("copies")])
    return newest.select(
        F.lit(UNIQUE_RULES[spec.name]).alias("rule_id"), F.lit(FAIL).alias("severity"), F.col("record_key").alias("record_id"),
        F.concat(F.lit(f"Duplicate {spec.key} found: "), F.col("record_key")).alias("message"), "copies",
    )
