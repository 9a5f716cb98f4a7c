"""Exact quantiles per group without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import written

#: Distinct values that are ordered together, parts of a range, and copies of its bounds that its values meet.
MOST_VALUES, PARTS, COPIES = 1_000_000, 64, 16


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], most_values: int = MOST_VALUES
) -> DataFrame:
    """Interpolated quantiles ``group, probability, quantile``. Nulls are ignored.

    Values are counted per distinct value before any shuffle. The ranges that hold a wanted rank are cut at the quantiles of a mergeable
    sketch of their values, so their parts weigh about the same wherever the values lie; counts tell which part holds the rank,
    and only that one is looked at further. When no range has more than ``most_values`` distinct values, they are ordered. Rounds grow with the
    logarithm of the number of values, and the result is exact, as the sketch only chooses the cuts.
    """
    keys = list(group)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_range", F.lit(0).cast("long"))
    )
    rows = written(counted, "values")
    totals = rows.groupBy(*keys, "_range").agg(F.sum("_n").alias("_total"))
    wanted = F.inline(F.flatten(F.array(*[_ranks(p) for p in probabilities])))
    targets = totals.select(*keys, "_range", wanted)
    widest = _widest(rows, keys)
    while widest > most_values:
        rows, targets = _narrowed(rows, targets, keys)
        before, widest = widest, _widest(rows, keys)
        if widest >= before:
            break
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    placed = rows.withColumn("_end", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = _meet(placed, targets, [*keys, "_range"]).filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    low = F.max(F.when(F.col("_side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_v")))
    share = F.max("_share")
    return (
        found.groupBy(*keys, "probability")
        .agg((low + (high - low) * share).alias("quantile"))
    )


def _widest(rows: DataFrame, keys: list[str]) -> int:
    """Most distinct values of any open range."""
    return rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _meet(values: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join a few rows per range to its many values. The values are spread over copies of those rows, so one range is no single task's work.

    Group keys are compared null-safely.
    """
    spread = values.withColumn("_copy", F.pmod(F.xxhash64("_v"), F.lit(COPIES)).cast("int")).alias("x")
    copied = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).alias("y")
    rule = F.col("x._copy") == F.col("y._copy")
    for c in on:
        rule = rule & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    more = [F.col(f"y.{c}") for c in small.columns if c not in on]
    return spread.join(copied, rule).select(*[F.col(f"x.{c}") for c in values.columns], *more)


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The parts of the open ranges that hold a wanted rank, with ranks counted from their start."""
    on = [*keys, "_range"]
    sketch = rows.groupBy(*on).agg(F.kll_sketch_agg_double("_v").alias("_sketch"))
    steps = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    bounds = sketch.select(*on, F.kll_sketch_get_quantile_double("_sketch", steps).alias("_bounds"))
    part = F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).cast("long")
    cut = written(_meet(rows, bounds, on).withColumn("_part", part).drop("_bounds"), "values")
    by_range = Window.partitionBy(*on).orderBy("_part")
    sizes = cut.groupBy(*on, "_part").agg(F.sum("_n").alias("_size"))
    placed = sizes.withColumn("_below", F.sum("_size").over(by_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"))
    rule = (F.col("t._rank") >= F.col("p._below")) & (F.col("t._rank") < F.col("p._below") + F.col("p._size"))
    for c in on:
        rule = rule & F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}"))
    inner = F.col("_range") * PARTS + F.col("_part")
    hit = written(targets.alias("t").join(placed.alias("p"), rule).select("t.*", "p._part", (F.col("t._rank") - F.col("p._below")).alias("_inner")), "targets")
    kept = _meet(cut.withColumn("_next", inner), hit.select(*keys, inner.alias("_next")).distinct(), [*keys, "_next"])
    left = kept.select(*keys, "_v", "_n", F.col("_next").alias("_range"))
    named = hit.select(*keys, inner.alias("_range"), "probability", F.col("_inner").alias("_rank"), "_side", "_share")
    return written(left, "values"), named


def _ranks(p: float) -> Column:
    """Lower and upper zero-based rank of a quantile and the share between them."""
    position = F.lit(p) * (F.col("_total") - 1)
    low, high = F.floor(position), F.ceil(position)
    return F.array(*[
        F.struct(F.lit(p).alias("probability"), rank.cast("long").alias("_rank"), F.lit(side).alias("_side"), (position - low).alias("_share"))
        for side, rank in ((0, low), (1, high))
    ])
