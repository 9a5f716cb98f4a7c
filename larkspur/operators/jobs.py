"""Refresh jobs over snapshot tables: features and vector index of the curated tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import features as ft
from larkspur.operators.index import IndexRun, index_rows, upsert_points
from larkspur.sources.snapshots import UNKNOWN, SnapshotStore
from larkspur.sources.specs import ARTICLES, SOURCES, TRIALS, SourceSpec

_STATS = {ARTICLES.name: ("article_stats", ft.article_stats), TRIALS.name: ("trial_stats", ft.trial_stats)}


def refresh_features(store: SnapshotStore, run_id: str, at: dt.datetime, view_version: str = "1") -> DataFrame:
    """Compute features of every curated table, append them to the history and publish the newest row per key.

    Feature rows name the snapshot of their own curated table. Returns ``source_name, computed`` per source.
    """
    counts = []
    for spec in SOURCES.values():
        name, stats = _STATS[spec.name]
        ref = store.latest_snapshot_id(spec.curated_table)
        if ref == UNKNOWN:
            continue
        rows = stats(store.read(spec.curated_table, snapshot_id=ref), F.lit(ref))
        store.append(f"{name}_history", ft.stamp_features(rows, F.lit(at), run_id, view_version), run_id, at)
        history = store.read(f"{name}_history")
        store.write(name, ft.materialise_features(history, spec.key, at), run_id, at)
        written = history.filter(F.col("run_id") == run_id)
        counts.append(written.agg(F.count(F.lit(1)).alias("computed")).withColumn("source_name", F.lit(spec.name)))
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def index_table(spec: SourceSpec) -> str:
    return f"index_{spec.collection}"


def refresh_index(store: SnapshotStore, spec: SourceSpec, run: IndexRun, at: dt.datetime) -> DataFrame:
    """Embed a curated table and publish its collection with the new points upserted. Returns one row ``indexed``.

    Curated rows are unique by key, so a first run needs no shuffle at all; later ones shuffle to replace old points.
    A run that is already published is not computed again, whichever run came after it.
    """
    name = index_table(spec)
    if not store.has(name, run.run_id):
        ref = store.latest_snapshot_id(spec.curated_table)
        points = index_rows(store.read(spec.curated_table, snapshot_id=ref), spec, ref, run)
        if store.latest_snapshot_id(name) != UNKNOWN:
            points = upsert_points(store.read(name), points)
        store.write(name, points, run.run_id, at)
    return store.read(name).filter(F.col("indexing_run_id") == run.run_id).agg(F.count(F.lit(1)).alias("indexed"))
