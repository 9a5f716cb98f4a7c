"""Entity features: statistics, refresh, registry and lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as fx
from larkspur.operators.asof import as_of_join
from larkspur.operators.dedup import latest_per_key

# Validity of a feature value and the window of one refresh, in days.
FEATURE_TTL_DAYS = 365
REFRESH_DAYS = 730

ARTICLE_FEATURES = (
    "title_word_count", "abstract_word_count", "publication_year", "has_abstract", "journal_encoded", "snapshot_ref",
)
TRIAL_FEATURES = ("sample_size", "has_outcomes", "status_encoded", "condition_count", "snapshot_ref")


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def article_stats(articles: DataFrame, snapshot_ref: Column | str = "snapshot_ref") -> DataFrame:
    """One row of features per article row; a single projection."""
    return articles.select(
        "pmid",
        fx.word_count("title").alias("title_word_count"),
        fx.word_count("abstract").alias("abstract_word_count"),
        fx.publication_year("publication_date").alias("publication_year"),
        fx.presence_flag("abstract").alias("has_abstract"),
        _or_empty("journal").alias("journal_encoded"),
        _or_empty(snapshot_ref).alias("snapshot_ref"),
    )


def trial_stats(trials: DataFrame, snapshot_ref: Column | str = "snapshot_ref") -> DataFrame:
    """One row of features per trial row.

    ``conditions`` and ``primary_outcomes`` may be arrays (non-blank items count) or plain text (comma rule).
    """

    def is_array(name: str) -> bool:
        return isinstance(trials.schema[name].dataType, T.ArrayType)

    if is_array("primary_outcomes"):
        outcomes = (fx.list_item_count("primary_outcomes", is_array=True) > 0).cast("long")
    else:
        outcomes = fx.presence_flag("primary_outcomes")
    return trials.select(
        "nct_id",
        fx.null_to_zero_int("sample_size").alias("sample_size"),
        outcomes.alias("has_outcomes"),
        _or_empty("status").alias("status_encoded"),
        fx.list_item_count("conditions", is_array=is_array("conditions")).alias("condition_count"),
        _or_empty(snapshot_ref).alias("snapshot_ref"),
    )


def stamp_features(stats: DataFrame, event_timestamp: Column, run_id: str, view_version: str) -> DataFrame:
    """Feature rows as they are written: one event time per run, plus the lineage the rules ask for."""
    return stats.withColumns(
        {"event_timestamp": event_timestamp, "run_id": F.lit(run_id), "view_version": F.lit(view_version)}
    )


def materialise_features(history: DataFrame, key: str, end: dt.datetime | Column, days: int = REFRESH_DAYS) -> DataFrame:
    """Newest feature row per key with ``end - days < event_timestamp <= end``."""
    until = end if isinstance(end, Column) else F.lit(end)
    recent = history.filter(
        (F.col("event_timestamp") <= until) & (F.col("event_timestamp") > until - F.expr(f"INTERVAL {days} DAYS"))
    )
    return latest_per_key(recent, [key], [F.desc("event_timestamp")])


def feature_lookup(keys: DataFrame, features: DataFrame, key: str, lead: str) -> DataFrame:
    """Features of the given keys in request order (``position``), duplicates kept, unknown keys omitted.

    A row whose leading feature is null counts as unknown. The feature table is unique by key; Catalyst broadcasts
    the smaller side only below its size threshold and adaptive execution splits hot keys otherwise.
    """
    return keys.join(features.filter(F.col(lead).isNotNull()), key, "inner")


def features_as_of(
    requests: DataFrame, history: DataFrame, key: str, request_ts: str, values: list[str],
    ttl_days: int = FEATURE_TTL_DAYS, tie_break: str | None = None, blocks: int | None = None,
) -> DataFrame:
    """Feature values valid at each request time; see :func:`as_of_join`."""
    return as_of_join(requests, history, key, request_ts, "event_timestamp", values, ttl_days, tie_break, blocks)


def feature_staleness(features: DataFrame, current: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """DQ-FEAST-3: feature tables whose snapshot is not the current one, or that are too old.

    ``features`` has ``table_name, snapshot_ref, event_timestamp`` per feature row, ``current`` one
    ``table_name, snapshot_id`` row per table; the features are aggregated before they meet.
    """
    newest = features.groupBy("table_name", "snapshot_ref").agg(
        F.max("event_timestamp").alias("refreshed_at"), F.count(F.lit(1)).alias("feature_rows")
    )
    joined = newest.join(current.select("table_name", "snapshot_id"), "table_name", "left")
    outdated = ~F.col("snapshot_ref").eqNullSafe(F.coalesce("snapshot_id", F.lit("unknown")))
    too_old = F.col("refreshed_at") < now - F.expr(f"INTERVAL {max_age_hours} HOURS")
    return joined.withColumns(
        {"snapshot_outdated": outdated, "too_old": too_old, "stale": outdated | too_old}
    )


def feature_registry(spark: SparkSession) -> DataFrame:
    """Entities, keys, fields, types, units and validity of the feature views, as a table of fixed definitions."""
    # Units and null rules of the features.
    units = {
        "title_word_count": "words", "abstract_word_count": "words", "publication_year": "year", "has_abstract": "flag",
        "sample_size": "participants", "has_outcomes": "flag", "condition_count": "conditions",
    }
    rows = []
    for view, entity, key, fields in (
        ("article_stats", "article", "pmid", ARTICLE_FEATURES),
        ("trial_stats", "trial", "nct_id", TRIAL_FEATURES),
    ):
        for field in fields:
            unit = units.get(field)
            rows.append((view, entity, key, field, "bigint" if unit else "string", unit, "0 when unknown" if unit else "empty when unknown", FEATURE_TTL_DAYS))
    schema = "view STRING, entity STRING, join_key STRING, field STRING, data_type STRING, units STRING, null_rule STRING, ttl_days INT"
    return spark.createDataFrame(rows, schema)


def outcome_summary(df: DataFrame, group: list[str], value: str, success: Column) -> DataFrame:
    """Count, known values, mean, deviation and success rate per group; unknown values stay out of the numbers."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("outcomes"),
        F.count(value).alias("known"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("sd_value"),
        (F.count_if(success) / F.count(F.lit(1))).alias("success_rate"),
    )
