"""Vector index tables: build, upsert, drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.functions.vectors import Encoder, embed, hash_encoder, l2_norm
from larkspur.operators.dedup import upsert
from larkspur.sources.specs import ARTICLES, TRIALS, SourceSpec


@dataclass(frozen=True)
class IndexRun:
    """Model and run names that every index row carries."""

    run_id: str
    model: str = "hashed-words"
    model_version: str = "1"
    encoder: Encoder = hash_encoder


def _as_text(name: str, df: DataFrame) -> Column:
    """A list column as comma text; text stays text."""
    is_array = df.schema[name].dataType.typeName() == "array"
    return F.array_join(name, ", ") if is_array else F.coalesce(F.col(name), F.lit(""))


def index_texts(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """``doc_id, title, content, snippet, embedding_text, date_from, date_to, source_type`` of curated rows."""
    if spec is ARTICLES:
        title, date = "title", "publication_date"
        content = F.coalesce(F.col("abstract"), F.lit(""))
        text = fx.article_text("title", "abstract")
    else:
        title, date = "brief_title", "start_date"
        conditions, interventions = _as_text("conditions", df), _as_text("interventions", df)
        content = fx.join_nonempty(conditions, interventions)
        text = fx.trial_text("brief_title", conditions, interventions)
    return df.select(
        fx.doc_key(spec.key_prefix, spec.key).alias("doc_id"),
        F.coalesce(F.col(title), F.lit("")).alias("title"),
        fx.snippet(content).alias("snippet"),
        content.alias("content"),
        F.lit(spec.source_type).alias("source_type"),
        F.lit(spec.collection).alias("collection"),
        fx.date_lower(date).alias("date_from"),
        fx.date_upper(date).alias("date_to"),
        text.alias("embedding_text"),
    )


def index_rows(df: DataFrame, spec: SourceSpec, snapshot_ref: str | Column, run: IndexRun) -> DataFrame:
    """Index rows of curated rows (unique by key): point id, unit vector and payload. One narrow stage, no shuffle."""
    ref = snapshot_ref if isinstance(snapshot_ref, Column) else F.lit(snapshot_ref)
    return (
        index_texts(df, spec)
        .withColumn("vector", embed("embedding_text", run.encoder))
        .select(
            fx.uuid5("doc_id").alias("point_id"), "vector", "doc_id", "title", "snippet", "content", "source_type",
            "collection", "date_from", "date_to",
            F.lit(run.model).alias("embedding_model"), F.lit(run.model_version).alias("embedding_model_version"),
            F.lit(run.run_id).alias("indexing_run_id"), ref.alias("snapshot_ref"),
        )
    )


def index_articles(articles: DataFrame, snapshot_ref: str, run: IndexRun) -> DataFrame:
    return index_rows(articles, ARTICLES, snapshot_ref, run)


def index_trials(trials: DataFrame, snapshot_ref: str, run: IndexRun) -> DataFrame:
    return index_rows(trials, TRIALS, snapshot_ref, run)


def upsert_points(index: DataFrame, points: DataFrame, key: str = "point_id", order: list | None = None) -> DataFrame:
    """Insert or replace by point id; within the new points the last by ``order`` wins."""
    return upsert(index, points, key, order if order is not None else [F.desc("indexing_run_id")])


def coverage(documents: DataFrame, index: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(embedded, missing)`` documents."""
    keys = index.select(key)
    return documents.join(keys, key, "left_semi"), documents.join(keys, key, "left_anti")


def index_drift(documents: DataFrame, index: DataFrame, current_ref: Column | str, key: str = "doc_id") -> DataFrame:
    """One row: documents without a vector, vectors of another snapshot, and the spread of vector norms.

    Norms are computed at the scan; only key, staleness and norm reach the join.
    """
    ref = F.lit(current_ref) if isinstance(current_ref, str) else current_ref
    slim = index.select(
        key, (~F.col("snapshot_ref").eqNullSafe(ref)).alias("stale"), l2_norm("vector").alias("norm"), F.lit(True).alias("indexed")
    )
    joined = documents.select(key).join(slim, key, "left")
    total = F.count(F.lit(1))
    return joined.agg(
        total.alias("documents"),
        F.count("indexed").alias("embedded"),
        (F.count_if(F.col("indexed").isNull()) / total).alias("missing_share"),
        (F.count_if(F.col("stale")) / F.count("indexed")).alias("stale_share"),
        F.min("norm").alias("min_norm"), F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm"),
    )
