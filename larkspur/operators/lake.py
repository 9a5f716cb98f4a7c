"""Deliveries into a lake of run and key tables: ingest a run, curate it, refresh features and index for what changed.

Every step reads the new runs, or the rows the step before has changed, and the buckets these touch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.index import IndexRun, index_rows
from larkspur.operators.ingest import IngestRun, delivered_outcomes
from larkspur.operators.normalise import mark_rejects, project_curated
from larkspur.operators.quality import UNIQUE_RULES, gate, results_of, run_dq, source_rules, split_quarantine
from larkspur.session import written
from larkspur.sources.specs import SourceSpec
from larkspur.sources.tables import KeyedTable, RunTable

_RUN = "ingestion_run_id"
_VIOLATIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("rule_id", "severity", "record_id", "message", _RUN)])


@dataclass(frozen=True)
class Lake:
    """A folder of tables. ``buckets`` is the number of folders of each key table; a bucket should fill a few tasks at most."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def raw(self, spec: SourceSpec) -> RunTable:
        return RunTable(self.spark, f"{self.root}/{spec.raw_table}", spec.raw_schema)

    def rejects(self, spec: SourceSpec) -> RunTable:
        extra = [T.StructField("parse_error", T.StringType()), T.StructField("rejected_record", T.StringType())]
        return RunTable(self.spark, f"{self.root}/{spec.raw_table}_rejects", T.StructType([*spec.raw_schema.fields, *extra]))

    def violations(self, spec: SourceSpec) -> RunTable:
        return RunTable(self.spark, f"{self.root}/{spec.raw_table}_violations", _VIOLATIONS)

    def curated(self, spec: SourceSpec) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{spec.curated_table}", spec.key, ["ingested_at", _RUN], self.buckets, spec.curated_schema)

    def index(self, spec: SourceSpec) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/index_{spec.collection}", "doc_id", ["indexed_at", "indexing_run_id"], self.buckets)


def ingest_run(lake: Lake, records: DataFrame, spec: SourceSpec, run: IngestRun) -> DataFrame:
    """Ingest one delivery as one run and return its rule results.

    The delivery is parsed once; the rules are evaluated once, and the results are counted from the stored violations. With
    ``mode="block"`` a failing rule refuses the run: its violations stay, its rows do not come in. A refused or repeated run is
    written again under its own id and replaces itself.
    """
    parsed = written(delivered_outcomes(mark_rejects(records, spec), spec, run), "parsed")
    found = written(run_dq(parsed, spec).withColumn(_RUN, F.lit(run.run_id)), "violations")
    lake.violations(spec).write(found, run.run_id)
    rules = [(r.rule_id, r.severity) for r in source_rules(spec)] + [(UNIQUE_RULES[spec.name], "FAIL")]
    results = results_of(found, parsed.select(_RUN), rules, run.run_id)
    if run.mode == "block":
        gate(results)
    good, rejected = parsed.filter("parse_error IS NULL"), parsed.filter("parse_error IS NOT NULL")
    if run.mode == "quarantine":
        good, bad = split_quarantine(good, source_rules(spec))
        rejected = rejected.unionByName(bad.withColumn("parse_error", F.array_join("dq_rules", ",")).drop("dq_rules"))
    lake.rejects(spec).write(rejected, run.run_id)
    lake.raw(spec).write(good, run.run_id)
    return results


def curate_runs(lake: Lake, spec: SourceSpec, runs: Sequence[str], curated_at: dt.datetime) -> DataFrame:
    """Merge some runs into the curated table and return the curated rows that changed. The order of calls does not matter."""
    delivered = lake.raw(spec).read(runs)
    return lake.curated(spec).upsert(project_curated(delivered, spec, curated_at))


def index_changes(lake: Lake, spec: SourceSpec, changed: DataFrame, snapshot_ref: str, run: IndexRun, at: dt.datetime) -> DataFrame:
    """Embed changed curated rows, unique by key as ``curate_runs`` returns them, and upsert them. Returns the index rows that changed."""
    rows = index_rows(changed, spec, snapshot_ref, run).withColumn("indexed_at", F.lit(at).cast("timestamp"))
    return lake.index(spec).upsert(rows, unique=True)
