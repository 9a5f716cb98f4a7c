"""Newest row per key, duplicate keys and incremental merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*df.columns)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], tie_break: Sequence[Column | str] | None = None
) -> DataFrame:
    """The first row per key by ``order`` (usually descending times).

    Rank 1 is pruned in every map task before the shuffle (``WindowGroupLimit``), so a key that holds a third of all
    rows sends one row per task. Ties end at a hash of the whole row unless ``tie_break`` says otherwise.
    """
    last = list(tie_break) if tie_break is not None else [_row_hash(df)]
    window = Window.partitionBy(*keys).orderBy(*order, *last)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def newest_version(df: DataFrame, key: str) -> DataFrame:
    """Curation: newest ``ingested_at`` per key, later run id on ties."""
    return latest_per_key(df, [key], [F.desc("ingested_at"), F.desc("ingestion_run_id")])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, copies`` of keys that occur more than once; null is no key, blank is one."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def upsert(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, plus the newest row per key of ``new``."""
    fresh = latest_per_key(new, [key], order)
    return old.join(new.select(key), key, "left_anti").unionByName(fresh)


def merge_newest(curated: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incremental curation: newest version of the curated rows and a new run, the same as curating both at once."""
    return newest_version(curated.unionByName(incoming), key)
