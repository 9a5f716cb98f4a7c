"""Service metrics over an event log: success, volume, latency, violations, distributions, acceptance.

All metrics are keyed partial aggregations (window, status, rule, bucket), so no group of rows is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Latency bounds in seconds, rate window, and the dashboard's bands.
LATENCY_BOUNDS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0)
RATE_WINDOW = "5 minutes"
RATE_SECONDS = 300
SUCCESS_BANDS = (0.80, 0.95)
LATENCY_BANDS = (10.0, 30.0)
VIOLATION_BANDS = (1, 10)
ACCEPTED_P95 = 30.0
ACCEPTED_SUCCESS = 0.95


def _start(ts: str, width: str, slide: str | None = None) -> Column:
    return (F.window(ts, width, slide) if slide else F.window(ts, width)).alias("w")


def success_ratio(log: DataFrame, ts: str = "ts", status: str = "status", count_blocked: bool = False, width: str = RATE_WINDOW, slide: str | None = None) -> DataFrame:
    """Approved share per window. Blocked questions are not counted unless asked for; one without a status counts as not approved."""
    rows = log if count_blocked else log.filter(~F.col(status).eqNullSafe("blocked"))
    return (
        rows.groupBy(_start(ts, width, slide))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "approved").alias("approved"))
        .select(F.col("w.start").alias("window_start"), "total", "approved", (F.col("approved") / F.col("total")).alias("success_ratio"))
    )


def volume_by_status(log: DataFrame, ts: str = "ts", status: str = "status", width: str = RATE_WINDOW) -> DataFrame:
    """Events per second by window and status."""
    return (
        log.groupBy(_start(ts, width), status).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), status, "n", (F.col("n") / RATE_SECONDS).alias("per_second"))
    )


def latency_buckets(log: DataFrame, duration: str = "duration_s", group: Sequence[Column | str] = ()) -> DataFrame:
    """Counts per latency bucket; bucket ``len(LATENCY_BOUNDS)`` holds what is above the last bound. Null durations are in no bucket."""
    bucket = F.lit(len(LATENCY_BOUNDS))
    for i in range(len(LATENCY_BOUNDS) - 1, -1, -1):
        bucket = F.when(F.col(duration) <= LATENCY_BOUNDS[i], F.lit(i)).otherwise(bucket)
    return log.filter(F.col(duration).isNotNull()).groupBy(*group, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def latency_quantiles(log: DataFrame, probabilities: Sequence[float], duration: str = "duration_s", ts: str | None = None, width: str = RATE_WINDOW) -> DataFrame:
    """Quantiles from the bucket counts, linear inside a bucket, the last bound above it.

    With ``ts`` one row per window and probability, else one per probability. Only bucket counts are ordered.
    """
    group = [F.window(ts, width).alias("w")] if ts else []
    keys = ["w"] if ts else []
    counts = latency_buckets(log, duration, group)
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = per_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = counts.withColumns({"cum": F.sum("n").over(running), "total": F.sum("n").over(per_key)})
    bounds = F.array(*[F.lit(b) for b in (0.0, *LATENCY_BOUNDS)])
    lower = F.try_element_at(bounds, F.col("bucket") + 1)
    upper = F.coalesce(F.try_element_at(bounds, F.col("bucket") + 2), F.lit(LATENCY_BOUNDS[-1]))
    wanted = F.explode(F.array(*[F.lit(p) for p in probabilities]))
    rank = F.col("probability") * F.col("total")
    inside = cumulative.select(*keys, "bucket", "n", "cum", "total", wanted.alias("probability")).filter(
        (F.col("cum") >= rank) & (F.col("cum") - F.col("n") < rank)
    )
    value = F.when(F.col("bucket") == len(LATENCY_BOUNDS), F.lit(LATENCY_BOUNDS[-1])).otherwise(
        lower + (upper - lower) * ((rank - (F.col("cum") - F.col("n"))) / F.col("n"))
    )
    start = [F.col("w.start").alias("window_start")] if ts else []
    return inside.select(*start, "probability", F.col("total").alias("queries"), value.alias("latency_s"))


def violation_rate(log: DataFrame, rule: str = "rule", ts: str = "ts", width: str = RATE_WINDOW) -> DataFrame:
    """Violations per second by window and rule; rows without a rule are no violations."""
    return (
        log.filter(F.col(rule).isNotNull()).groupBy(_start(ts, width), rule).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), rule, "n", (F.col("n") / RATE_SECONDS).alias("per_second"))
    )


def violation_totals(log: DataFrame, rule: str = "rule") -> DataFrame:
    return log.filter(F.col(rule).isNotNull()).groupBy(rule).agg(F.count(F.lit(1)).alias("violations"))


def total_queries(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total_queries"))


def ingested_by_source(records: DataFrame, source: str = "source_name") -> DataFrame:
    return records.groupBy(source).agg(F.count(F.lit(1)).alias("records"))


def slo_status(log: DataFrame, status: str = "status", duration: str = "duration_s", rule: str = "rule") -> DataFrame:
    """Three rows ``metric, value, band`` for success ratio, p95 latency and violations, from one pass each."""
    counted = F.col(status) != "blocked"
    base = log.agg(
        (F.count_if(counted & (F.col(status) == "approved")) / F.count_if(counted)).alias("success"),
        F.count(rule).cast("double").alias("violations"),
    )
    success = base.select(F.lit("success_ratio").alias("metric"), F.col("success").alias("value"), _band(F.col("success"), SUCCESS_BANDS, rising=True).alias("band"))
    violations = base.select(F.lit("dq_violations").alias("metric"), F.col("violations").alias("value"), _band(F.col("violations"), VIOLATION_BANDS).alias("band"))
    p95 = latency_quantiles(log, [0.95], duration).select(
        F.lit("p95_latency_s").alias("metric"), F.col("latency_s").alias("value"), _band(F.col("latency_s"), LATENCY_BANDS).alias("band")
    )
    return success.unionByName(p95).unionByName(violations)


def _band(value: Column, bands: Sequence[float], rising: bool = False) -> Column:
    low, high = ("red", "green") if rising else ("green", "red")
    return F.when(value < bands[0], low).when(value < bands[1], "yellow").otherwise(high)


def load_acceptance(requests: DataFrame, p95: DataFrame) -> DataFrame:
    """One row: share of answered requests with citations, the given p95, and whether both targets are met."""
    good = (F.col("http_status") == 200) & (F.col("citations") > 0)
    unknown = F.lit(None)
    share = requests.agg(
        F.count(F.lit(1)).alias("requests"), (F.count_if(good) / F.count(F.lit(1))).alias("success_rate")
    ).withColumn("p95_s", unknown.cast("double"))
    limit = p95.agg(F.max("quantile").alias("p95_s")).withColumns(
        {"requests": unknown.cast("long"), "success_rate": unknown.cast("double")}
    )
    both = share.unionByName(limit).agg(*[F.max(c).alias(c) for c in ("requests", "success_rate", "p95_s")])
    return both.withColumn("accepted", (F.col("success_rate") >= ACCEPTED_SUCCESS) & (F.col("p95_s") <= ACCEPTED_P95))


def language_distribution(documents: DataFrame, lang: str = "lang", home: str = "en", limit: float = 0.5) -> DataFrame:
    """Share per language and whether the share of other languages is above ``limit``. One row per language."""
    counts = documents.groupBy(lang).agg(F.count(F.lit(1)).alias("documents"))
    everything = Window.partitionBy(F.lit(0))
    share = F.col("documents") / F.sum("documents").over(everything)
    foreign = F.sum(F.when(F.col(lang) != home, F.col("documents")).otherwise(0)).over(everything) / F.sum("documents").over(everything)
    return counts.select(lang, "documents", share.alias("share"), (foreign > limit).alias("high_foreign_share"))


def status_distribution(trials: DataFrame, run: str = "run", status: str = "status", spike: float = 0.1) -> DataFrame:
    """Share of each status per run, its change since the run before, and a flag for changes above ``spike``."""
    counts = trials.groupBy(run, status).agg(F.count(F.lit(1)).alias("trials"))
    share = F.col("trials") / F.sum("trials").over(Window.partitionBy(run))
    shared = counts.withColumn("share", share)
    before = F.lag("share").over(Window.partitionBy(status).orderBy(run))
    return shared.withColumn("change", F.col("share") - before).withColumn("spike", F.coalesce(F.abs("change") > spike, F.lit(False)))
