"""Time-ordered lookups that never put a whole key into one task.

Rows are dealt into blocks by a range partitioning over key, time and tie-breaks, so a block holds a bounded number of rows and a
key with very many of them, even at one moment, is spread over neighbouring blocks. Inside a block the rows are ordered; per key
and block one summary row travels on, and is carried forward from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import written


def in_blocks(df: DataFrame, order: Sequence[str | Column], blocks: int | None = None) -> DataFrame:
    """The rows with ``_block``, which ascends with ``order``. They are stored once, so a block keeps its rows.

    ``blocks`` is the number of blocks; by default the session's shuffle partitions, joined by adaptive execution where small.
    """
    dealt = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    return written(dealt.withColumn("_block", F.spark_partition_id()), "blocks")


def as_of_join(
    requests: DataFrame, history: DataFrame, key: str, request_ts: str, history_ts: str, values: Sequence[str],
    ttl_days: int | None = None, tie_break: str | None = None, blocks: int | None = None,
) -> DataFrame:
    """Each request with the newest ``values`` of its key at or before its time, and ``history_ts`` as ``valid_from``.

    Values ``ttl_days`` old or older count as absent. ``tie_break`` decides between history
    rows of the same time (highest wins).
    """
    tie = F.col(tie_break).cast("long") if tie_break else F.lit(0).cast("long")
    value = F.struct(F.col(history_ts).alias("valid_from"), *[F.col(v) for v in values])
    facts = history.select(
        F.col(key).alias("_key"), F.col(history_ts).alias("_ts"), F.lit(0).alias("_side"), tie.alias("_tie"), value.alias("_value"),
    )
    asks = requests.select(
        F.col(key).alias("_key"), F.col(request_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"),
        F.struct(*requests.columns).alias("_ask"),
    )
    empty_ask, empty_value = asks.schema["_ask"].dataType, facts.schema["_value"].dataType
    both = facts.withColumn("_ask", F.lit(None).cast(empty_ask)).unionByName(asks.withColumn("_value", F.lit(None).cast(empty_value)))
    # The hash deals out rows that are equal in all that orders them.
    order = ["_key", "_ts", "_side", "_tie", "_spread"]
    lane = in_blocks(both.withColumn("_spread", F.xxhash64("_ask", "_value")), order, blocks)

    # newest value before each block, from one row per key and block
    newest = lane.filter("_side = 0").groupBy("_key", "_block").agg(F.max_by("_value", F.struct("_ts", "_tie", "_spread")).alias("_newest"))
    asked = lane.filter("_side = 1").groupBy("_key", "_block").agg(F.lit(True).alias("_asked"))
    by_key = Window.partitionBy("_key").orderBy("_block")
    carried = (
        newest.join(asked, ["_key", "_block"], "full")
        .withColumn("_carried", F.last("_newest", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("_asked")).select("_key", "_block", "_carried")
    )

    # newest value inside the block, history before requests of the same time
    inside = Window.partitionBy("_key", "_block").orderBy(*order[1:])
    seen = (
        lane.withColumn("_seen", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_side") == 1)
        .join(carried, ["_key", "_block"], "left")
        .withColumn("_found", F.coalesce("_seen", "_carried"))
    )
    if ttl_days is not None:
        oldest = F.col("_ts") - F.expr(f"INTERVAL {ttl_days} DAYS")
        seen = seen.withColumn("_found", F.when(F.col("_found.valid_from") > oldest, F.col("_found")))
    return seen.select("_ask.*", "_found.valid_from", *[F.col(f"_found.{v}").alias(v) for v in values])


def timeline_steps(events: DataFrame, key: str, ts: str, order: str, blocks: int | None = None) -> DataFrame:
    """Add ``elapsed_ms`` since the first event of the key and ``step_ms`` since the previous one (0 for the first).

    ``order`` breaks ties between events of the same time.
    """
    dealt = in_blocks(events, [key, ts, order], blocks)
    by_key = Window.partitionBy(key).orderBy("_block")
    spans = (
        dealt.groupBy(key, "_block").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
        .withColumn("_start", F.first("_first").over(by_key))
        .withColumn("_before", F.lag("_last").over(by_key))
        .select(key, "_block", "_start", "_before")
    )
    inside = Window.partitionBy(key, "_block").orderBy(ts, order)
    previous = F.coalesce(F.lag(ts).over(inside), F.col("_before"), F.col(ts))
    joined = dealt.join(spans, [key, "_block"])
    return joined.withColumns(
        {"elapsed_ms": _millis(F.col("_start"), F.col(ts)), "step_ms": _millis(previous, F.col(ts))}
    ).drop("_block", "_start", "_before")


def _millis(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / 1000).cast("long")
