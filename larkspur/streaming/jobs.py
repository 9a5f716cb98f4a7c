"""Structured Streaming forms of the batch operators; each calls the batch operator, none copies it.

Every job takes a streaming DataFrame and a checkpoint folder in shared storage, and returns a started query.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions.render import parse_event_line
from larkspur.operators.ingest import IngestRun
from larkspur.operators.lake import Lake, ingest_run
from larkspur.operators.metrics import success_ratio
from larkspur.operators.reports import event_rows
from larkspur.sources.specs import SourceSpec
from larkspur.sources.tables import KeyedTable


def stream_slo(
    log: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", width: str = "5 minutes", slide: str | None = None
) -> StreamingQuery:
    """Success ratio per window, written once the watermark has passed the window; later rows are dropped."""
    ratios = success_ratio(log.withWatermark("ts", delay), width=width, slide=slide)
    return (
        ratios.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )


def stream_step_events(lines: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", idle: str = "30 minutes") -> StreamingQuery:
    """First and last time and number of events per visit of a query from ``data:`` lines (columns ``line, ts``).

    Malformed lines are dropped. A visit ends when its query was idle for ``idle``; it is written, and its state dropped, once the
    watermark has passed that time. Sessions are merged in the map tasks first, so a busy query is no single task's work.
    """
    parsed = event_rows(lines, parse_event_line(F.col("line")), ["ts"]).withWatermark("ts", delay)
    visits = parsed.groupBy("query_id", F.session_window("ts", idle).alias("visit")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    micros = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts"))
    closed = visits.select("query_id", "events", "first_ts", "last_ts", F.floor(micros / 1000).cast("long").alias("elapsed_ms"))
    return (
        closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )


def _stream_name(name: str | None, checkpoint: str) -> str:
    """The given name, else one that follows from the checkpoint, which belongs to one stream only."""
    return name or f"stream-{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}"


def stream_ingest(
    records: DataFrame, lake: Lake, spec: SourceSpec, pipeline_version: str, ingested_at: dt.datetime, checkpoint: str, name: str | None = None
) -> StreamingQuery:
    """Ingest every micro-batch as one run in quarantine mode.

    The run id is the stream's name and the batch id, so a repeated batch replaces its own data and no other stream's. Uniqueness is
    judged inside a batch here and over all batches by :func:`larkspur.streaming.state.stream_uniqueness`; curation keeps the newest version.
    """

    stream = _stream_name(name, checkpoint)

    def load(batch: DataFrame, batch_id: int) -> None:
        ingest_run(lake, batch, spec, IngestRun(f"{stream}-{batch_id}", pipeline_version, ingested_at, mode="quarantine"))

    return (
        records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load).trigger(availableNow=True).start()
    )


def stream_curate(raw: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into ``table``: the newest version per key stays, in the buckets that the batch touches.

    A repeated batch changes nothing, so no batch ids are kept.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch)

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
