"""Ingestion of a source delivery: parse, validate, gate, append, curate."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.dedup import newest_version
from larkspur.operators.normalise import mark_rejects, normalise, project_curated
from larkspur.operators.quality import dq_results, gate, run_dq, source_rules, split_quarantine
from larkspur.sources.snapshots import SnapshotStore
from larkspur.sources.specs import SourceSpec


@dataclass(frozen=True)
class IngestRun:
    """Who ran, with which version, and when; passed in so a rerun gives the same rows."""

    run_id: str
    pipeline_version: str
    ingested_at: dt.datetime
    mode: str = "block"


def ingest(store: SnapshotStore, records: DataFrame, spec: SourceSpec, run: IngestRun) -> DataFrame:
    """Ingest one delivery and return its rule results.

    The records are parsed once into staged tables; the rules judge every delivered record there, rejects included, and the
    run becomes visible only when its log row is written. All violations are stored by run, also those of a refused run.
    ``mode="block"`` refuses the run on any failing rule, ``mode="quarantine"`` sets bad rows aside and lets the rest pass;
    its report still counts them. A refused delivery is repeated under a new run id.
    """
    marked = mark_rejects(records, spec)
    base = f"{spec.collection}_{run.run_id}"
    store.stage(f"{spec.raw_table}_parsed", delivered_outcomes(marked, spec, run), base)
    parsed = store.spark.read.parquet(f"{store.root}/{spec.raw_table}_parsed/{base}")

    good = parsed.filter(F.col("parse_error").isNull())
    rejected = parsed.filter(F.col("parse_error").isNotNull())
    if run.mode == "quarantine":
        good, bad = split_quarantine(good, source_rules(spec))
        broken = bad.withColumn("parse_error", F.array_join("dq_rules", ",")).drop("dq_rules")
        rejected = rejected.unionByName(broken)
    results = dq_results(parsed, spec)
    store.append(f"{spec.raw_table}_violations", run_dq(parsed, spec), base, run.ingested_at, job_version=run.pipeline_version)
    if run.mode == "block":
        gate(results)
    store.append(f"{spec.raw_table}_rejects", rejected, base, run.ingested_at)
    store.append(spec.raw_table, good.select(*spec.raw_schema.names), base, run.ingested_at, job_version=run.pipeline_version)
    return results


def delivered_outcomes(marked: DataFrame, spec: SourceSpec, run: IngestRun) -> DataFrame:
    """Normalised columns plus ``parse_error`` and, for rejects only, the delivered record as JSON."""
    delivered = [F.col(c) for c in marked.columns if c != "parse_error"]
    record = F.when(F.col("parse_error").isNotNull(), F.to_json(F.struct(*delivered)))
    return normalise(
        marked.withColumn("rejected_record", record), spec, run.run_id, run.pipeline_version, run.ingested_at,
        keep=("parse_error", "rejected_record"),
    )


def curate(store: SnapshotStore, spec: SourceSpec, snapshot_id: str, curated_at: dt.datetime) -> str:
    """Replace the curated table by the newest version per key of the raw table."""
    newest = newest_version(store.read(spec.raw_table), spec.key)
    return store.write(spec.curated_table, project_curated(newest, spec, curated_at), snapshot_id, curated_at)


def run_counts(parsed: DataFrame) -> DataFrame:
    """``records_in, parsed, rejected`` of marked records in one pass."""
    return parsed.agg(
        F.count(F.lit(1)).alias("records_in"),
        F.count_if(F.col("parse_error").isNull()).alias("parsed"),
        F.count_if(F.col("parse_error").isNotNull()).alias("rejected"),
    )
