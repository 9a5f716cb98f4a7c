"""Steps of a query in time order, split into visits by idle time. Batch forms of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_times(events: DataFrame, idle_ms: int) -> DataFrame:
    """``query_id, step_no, node, ts, elapsed_ms, step_ms`` of step events (``query_id, ts, position, node``).

    A step later than ``idle_ms`` after its predecessor starts a new visit of its query, where numbers and times start anew. Steps of
    equal time are ordered by ``position``, then ``node``.
    """
    order = ["ts", "position", "node"]
    before = F.lag("ts").over(Window.partitionBy("query_id").orderBy(*order))
    gap = F.timestamp_diff("MICROSECOND", before, F.col("ts"))
    split = events.withColumn("_fresh", F.coalesce((gap > idle_ms * 1000).cast("int"), F.lit(1)))
    numbered = split.withColumn("_visit", F.sum("_fresh").over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("query_id", "_visit").orderBy(*order)

    def millis(start):
        return F.floor(F.timestamp_diff("MICROSECOND", start, F.col("ts")) / 1000).cast("long")

    return numbered.select(
        "query_id", F.row_number().over(inside).cast("long").alias("step_no"), "node", "ts",
        millis(F.first("ts").over(inside)).alias("elapsed_ms"), F.coalesce(millis(F.lag("ts").over(inside)), F.lit(0)).alias("step_ms"),
    )
