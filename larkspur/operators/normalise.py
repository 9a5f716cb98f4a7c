"""Record normalisation, rejects and provenance."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as fx
from larkspur.sources.specs import ARTICLES, TRIALS, SourceSpec


def _empty_list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _key(name: str) -> Column:
    return fx.strip(F.col(name).cast("string")).alias(name)


def stamp_provenance(
    df: DataFrame, spec: SourceSpec, run_id: str | Column, pipeline_version: str, ingested_at: dt.datetime | Column
) -> DataFrame:
    """Add the six provenance columns; time and run come from the caller, never from the clock."""

    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    have = set(df.columns)
    optional = {c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("") for c in ("source_version", "source_uri")}
    return df.withColumns(
        {
            "source_name": F.lit(spec.name),
            **optional,
            "ingested_at": column(ingested_at).cast("timestamp"),
            "ingestion_run_id": column(run_id),
            "pipeline_version": F.lit(pipeline_version),
        }
    )


def normalise_articles(df: DataFrame, run_id, pipeline_version: str, ingested_at, keep: Sequence[str] = ()) -> DataFrame:
    stamped = stamp_provenance(df, ARTICLES, run_id, pipeline_version, ingested_at)
    return stamped.select(
        _key("pmid"), _text("title"), "abstract", _empty_list("authors"),
        fx.partial_iso_date("publication_date").alias("publication_date"), "journal",
        *[f.name for f in ARTICLES.raw_schema.fields[6:]], *keep,
    )


def normalise_trials(df: DataFrame, run_id, pipeline_version: str, ingested_at, keep: Sequence[str] = ()) -> DataFrame:
    stamped = stamp_provenance(df, TRIALS, run_id, pipeline_version, ingested_at)
    is_variant = isinstance(df.schema["sample_size"].dataType, T.VariantType)
    return stamped.select(
        _key("nct_id"), _text("brief_title"), _empty_list("conditions"), _empty_list("interventions"),
        _empty_list("primary_outcomes"), fx.safe_int("sample_size", variant=is_variant).alias("sample_size"),
        _text("status"), fx.partial_iso_date("start_date").alias("start_date"),
        fx.partial_iso_date("completion_date").alias("completion_date"),
        *[f.name for f in TRIALS.raw_schema.fields[9:]], *keep,
    )


def normalise(
    df: DataFrame, spec: SourceSpec, run_id, pipeline_version: str, ingested_at, keep: Sequence[str] = ()
) -> DataFrame:
    step = {ARTICLES.name: normalise_articles, TRIALS.name: normalise_trials}[spec.name]
    return step(df, run_id, pipeline_version, ingested_at, keep)


def mark_rejects(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Add ``parse_error``: null for good records."""
    unreadable = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    return df.withColumn(
        "parse_error",
        F.when(unreadable, F.lit("Record is no readable JSON"))
        .when(fx.is_blank(spec.key), F.lit(f"Record is missing required field '{spec.key}'")),
    )


def split_rejects(df: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``; rejected rows keep their original fields plus ``parse_error``."""
    marked = mark_rejects(df, spec)
    good = marked.filter(F.col("parse_error").isNull()).drop("parse_error", "_corrupt_record")
    return good, marked.filter(F.col("parse_error").isNotNull())


def project_curated(df: DataFrame, spec: SourceSpec, curated_at: dt.datetime | Column) -> DataFrame:
    """Add the curation columns and reorder to the curated schema."""
    at = curated_at if isinstance(curated_at, Column) else F.lit(curated_at)
    extra = {"curated_at": at.cast("timestamp")}
    if "snippet_count" in spec.curated_schema.names:
        extra["snippet_count"] = F.lit(0)
    return df.withColumns(extra).select(*spec.curated_schema.names)
