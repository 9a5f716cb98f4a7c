"""Data-quality rules, violations, reports, gate and quarantine.

A rule is a row predicate; all row rules of a table run in one scan. Uniqueness is the only rule that shuffles. Passing
rows are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.functions.render import parse_event_line
from larkspur.operators.dedup import duplicate_keys
from larkspur.sources.specs import ARTICLES, PROVENANCE, TRIALS, SourceSpec

FAIL, WARN, PASS = "FAIL", "WARN", "PASS"

VIOLATION_COLUMNS = ("rule_id", "severity", "record_id", "message")


@dataclass(frozen=True)
class Rule:
    """A row rule: ``failed`` is true for bad rows."""

    rule_id: str
    severity: str
    failed: Column
    message: Column


def _id(key: str) -> Column:
    return F.when(~fx.is_blank(key), F.col(key).cast("string")).otherwise(F.lit("unknown"))


def _python_list(items: Column) -> Column:
    """An array of names printed as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def blank_names(names: Sequence[str]) -> Column:
    """Names of the given columns that are blank in this row."""
    flagged = F.array(*[F.when(fx.is_blank(n), F.lit(n)) for n in names])
    return F.filter(flagged, lambda x: x.isNotNull())


def required(rule_id: str, severity: str, names: Sequence[str], what: str) -> Rule:
    """All the named columns must be non-blank; the message lists those that are not."""
    missing = blank_names(names)
    return Rule(rule_id, severity, F.size(missing) > 0, F.concat(F.lit(f"Missing {what} fields: "), _python_list(missing)))


def article_rules() -> list[Rule]:
    return [
        Rule("DQ-PUB-RAW-1", FAIL, fx.is_blank("pmid"), F.lit("pmid is null or empty")),
        Rule("DQ-PUB-CUR-2", FAIL, fx.is_blank("title"), F.concat(F.lit("title is empty for pmid="), _id("pmid"))),
        required("DQ-P1", FAIL, PROVENANCE, "provenance"),
    ]


def trial_rules() -> list[Rule]:
    return [
        Rule("DQ-CT-RAW-1", FAIL, fx.is_blank("nct_id"), F.lit("nct_id is null or empty")),
        required("DQ-P1", FAIL, PROVENANCE, "provenance"),
    ]


def article_warnings(raw_date: str = "raw_publication_date") -> list[Rule]:
    """Warnings on normalised articles that still carry the delivered date text."""
    bad_date = F.col(raw_date).isNotNull() & fx.partial_iso_date(raw_date).isNull()
    return [
        Rule("DQ-PUB-RAW-2", WARN, bad_date, F.concat(F.lit("publication_date cannot be read: "), F.col(raw_date))),
        Rule("DQ-PUB-CUR-3", WARN, fx.is_blank("abstract"), F.lit("abstract is missing")),
    ]


def trial_warnings() -> list[Rule]:
    return [
        Rule("DQ-CT-RAW-2", WARN, F.coalesce(F.size("primary_outcomes"), F.lit(0)) <= 0, F.lit("outcomes are missing")),
        Rule("DQ-CT-CUR-2", WARN, F.col("sample_size").isNull(), F.lit("sample_size is unknown")),
    ]


def lineage_rules() -> list[Rule]:
    return [required("DQ-P2", FAIL, ("snapshot_ref", "job_version"), "lineage")]


def feature_rules() -> list[Rule]:
    return [required("DQ-FEAST-1", FAIL, ("snapshot_ref", "view_version", "run_id"), "feature lineage")]


def registry_rules() -> list[Rule]:
    """Numeric registry entries must state units and what null means."""
    numeric = F.col("data_type").isin("bigint", "int", "double", "float")
    missing = blank_names(("units", "null_rule"))
    return [
        Rule("DQ-FEAST-2", FAIL, numeric & (F.size(missing) > 0), F.concat(F.lit("Missing registry fields: "), _python_list(missing)))
    ]


def vector_rules(dimension: int) -> list[Rule]:
    """Contract of an index row, and the fixed dimension of its collection."""
    return [
        required(
            "DQ-VEC-1", FAIL,
            ("doc_id", "snippet", "embedding_model_version", "indexing_run_id", "snapshot_ref"), "vector",
        ),
        Rule(
            "COLLECTION-DIM", FAIL, F.coalesce(F.size("vector"), F.lit(-1)) != dimension,
            F.concat(F.lit(f"expected {dimension} dimensions, got "), F.coalesce(F.size("vector"), F.lit(-1)).cast("string")),
        ),
    ]


def mention_rules() -> list[Rule]:
    return [required("DQ-X-1", WARN, ("doc_id", "section_no"), "mention")]


def snippet_rules() -> list[Rule]:
    return [required("DQ-X-2", FAIL, ("doc_id", "section_type", "section_text", "snapshot_ref"), "snippet")]


def answer_rules() -> list[Rule]:
    """Rules on answered questions: at least one citation, a structured reason on a refusal, a retrievable manifest."""
    no_citation = F.coalesce(F.size("citations"), F.lit(0)) <= 0
    return [
        Rule("DQ-UI-1", FAIL, no_citation, F.lit("Answer has no citation")),
        Rule("DQ-UI-4", FAIL, no_citation & fx.is_blank("refusal_reason"), F.lit("Refusal has no reason")),
        Rule("DQ-UI-5", WARN, ~F.col("manifest_found"), F.lit("Manifest cannot be retrieved; answer is degraded")),
    ]


def citation_rules() -> list[Rule]:
    """Rules on exploded citations (columns ``id, type, snippet``)."""
    missing = F.filter(
        F.array(
            F.when(fx.is_blank("id"), F.lit("id")),
            F.when(~F.coalesce(F.col("type").isin("article", "trial"), F.lit(False)), F.lit("type")),
            F.when(fx.is_blank("snippet"), F.lit("snippet")),
        ),
        lambda x: x.isNotNull(),
    )
    return [Rule("DQ-UI-2", FAIL, F.size(missing) > 0, F.concat(F.lit("Bad citation fields: "), _python_list(missing)))]


def event_rules(line: str = "line") -> list[Rule]:
    """Step events must parse and carry agent, status and summary."""
    event = parse_event_line(F.col(line))
    incomplete = fx.is_blank(event["agent"]) | fx.is_blank(event["status"]) | fx.is_blank(event["summary"])
    return [Rule("DQ-UI-3", FAIL, event.isNull() | incomplete, F.lit("Event is malformed"))]


def row_violations(df: DataFrame, rules: Sequence[Rule], record_id: Column, keep: Sequence[str] = ()) -> DataFrame:
    """One row per broken rule and record, in one scan and without a shuffle."""
    broken = F.array(
        *[
            F.when(
                r.failed,
                F.struct(
                    F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"),
                    record_id.cast("string").alias("record_id"), r.message.alias("message"),
                ),
            )
            for r in rules
        ]
    )
    found = F.filter(broken, lambda x: x.isNotNull())
    return df.select(*keep, F.inline(found))


def unique_violations(df: DataFrame, rule_id: str, key: str) -> DataFrame:
    """One row per key that occurs more than once."""
    return duplicate_keys(df, key).select(
        F.lit(rule_id).alias("rule_id"), F.lit(FAIL).alias("severity"), F.col(key).cast("string").alias("record_id"),
        F.concat(F.lit(f"Duplicate {key} found: "), F.col(key).cast("string")).alias("message"),
    )


# Uniqueness rule of each source.
UNIQUE_RULES = {ARTICLES.name: "DQ-PUB-CUR-1", TRIALS.name: "DQ-CT-CUR-1"}


def source_rules(spec: SourceSpec) -> list[Rule]:
    return {ARTICLES.name: article_rules, TRIALS.name: trial_rules}[spec.name]()


def run_dq(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """All violations of a source's rule set: row rules in one scan, then the uniqueness rule."""
    rows = row_violations(df, source_rules(spec), _id(spec.key))
    return rows.unionByName(unique_violations(df, UNIQUE_RULES[spec.name], spec.key))


def dq_results(df: DataFrame, spec: SourceSpec, run: str = "ingestion_run_id", sample: int = 10) -> DataFrame:
    """One row per run and rule: outcome, counts and the first ``sample`` failing ids.

    Counts are partial sums per map task; the sample is cut by rank before its shuffle, so a rule that every row
    breaks costs no more than one that few break.
    """
    rules = source_rules(spec)
    counted = df.groupBy(run).agg(
        F.count(F.lit(1)).alias("record_count"),
        *[F.count_if(r.failed).alias(f"_f{i}") for i, r in enumerate(rules)],
    )
    per_rule = counted.select(
        run, "record_count",
        F.inline(F.array(*[
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(f"_f{i}").alias("failed_count"))
            for i, r in enumerate(rules)
        ])),
    )
    copies = (
        df.filter(F.col(spec.key).isNotNull()).groupBy(run, spec.key).agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )
    unique = (
        counted.select(run, "record_count")
        .join(copies.groupBy(run).agg(F.count(F.lit(1)).alias("failed_count")), run, "left")
        .select(
            run, "record_count", F.lit(UNIQUE_RULES[spec.name]).alias("rule_id"), F.lit(FAIL).alias("severity"),
            F.coalesce("failed_count", F.lit(0)).alias("failed_count"),
        )
    )
    failing = row_violations(df, rules, _id(spec.key), keep=[run]).select(run, "rule_id", "record_id").unionByName(
        copies.select(run, F.lit(UNIQUE_RULES[spec.name]).alias("rule_id"), F.col(spec.key).cast("string").alias("record_id"))
    )
    samples = sample_ids(failing, [run, "rule_id"], "record_id", sample)
    return (
        per_rule.unionByName(unique).join(samples, [run, "rule_id"], "left")
        .select(
            run, "rule_id",
            F.when(F.col("failed_count") == 0, F.lit(PASS)).otherwise(F.col("severity")).alias("outcome"),
            F.concat(F.col("failed_count").cast("string"), F.lit(" of "), F.col("record_count").cast("string"), F.lit(" failed")).alias("message"),
            "record_count", "failed_count",
            F.coalesce("failed_ids", F.array().cast("array<string>")).alias("failed_ids"),
        )
    )


def results_of(violations: DataFrame, records: DataFrame, rules: Sequence[tuple[str, str]], run_id: str, sample: int = 10) -> DataFrame:
    """The rows of :func:`dq_results` for one run, counted from its stored violations (``rule_id``, ``record_id``) and its records.

    ``rules`` are the ids and severities of all rules that were judged; those without a violation passed.
    """
    listed = F.inline(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity")) for r, s in rules]))
    total = records.agg(F.count(F.lit(1)).alias("record_count")).select("record_count", listed)
    failed = violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    joined = total.join(failed, "rule_id", "left").join(sample_ids(violations, ["rule_id"], "record_id", sample), "rule_id", "left")
    counted = joined.withColumn("failed_count", F.coalesce("n", F.lit(0)))
    return counted.select(
        F.lit(run_id).alias("ingestion_run_id"), "rule_id",
        F.when(F.col("failed_count") == 0, F.lit(PASS)).otherwise(F.col("severity")).alias("outcome"),
        F.concat(F.col("failed_count").cast("string"), F.lit(" of "), F.col("record_count").cast("string"), F.lit(" failed")).alias("message"),
        "record_count", "failed_count", F.coalesce("failed_ids", F.array().cast("array<string>")).alias("failed_ids"),
    )


def sample_ids(df: DataFrame, group: Sequence[str], record_id: str, n: int) -> DataFrame:
    """The first ``n`` distinct ids per group as a sorted array ``failed_ids``."""
    # Equal ids are combined in the map tasks, so an id that most rows share is one row per task; of the distinct ids, the rank limit
    # leaves the first ones before the next shuffle.
    distinct = df.select(*group, record_id).distinct()
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(record_id))
    ranked = distinct.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return ranked.groupBy(*group).agg(F.array_sort(F.collect_list(record_id)).alias("failed_ids"))


def any_failure(results: DataFrame) -> DataFrame:
    """One row ``has_failures``; false for an empty result."""
    return results.agg(F.coalesce(F.bool_or(F.col("outcome") == FAIL), F.lit(False)).alias("has_failures"))


def dq_report(
    results: DataFrame, pipeline_version: str, source_name: str, evaluated_at: Column, run: str = "ingestion_run_id",
    snapshot_id: str | None = None,
) -> DataFrame:
    """One row per run; ``results`` is an array with one struct per rule, so its length is bounded by the rule set."""
    entry = F.struct("rule_id", "outcome", "message", "record_count", "failed_count", "failed_ids")
    return (
        results.groupBy(F.col(run).alias("run_id"))
        .agg(
            F.max("record_count").alias("total_records"),
            F.array_sort(F.collect_list(entry)).alias("results"),
            F.coalesce(F.bool_or(F.col("outcome") == FAIL), F.lit(False)).alias("has_failures"),
        )
        .select(
            "run_id", F.lit(pipeline_version).alias("pipeline_version"), F.lit(source_name).alias("source_name"),
            evaluated_at.alias("evaluated_at"), "total_records", "results", F.lit(snapshot_id).alias("snapshot_id"),
            "has_failures",
        )
    )


class QualityGateError(RuntimeError):
    """A blocking rule failed; the message holds the report."""


def gate(results: DataFrame) -> None:
    """Raise if any rule of the report failed. Reads one row per run and rule."""
    failed = results.filter(F.col("outcome") == FAIL).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("rule_id", "failed_count", "failed_ids")))).alias("report"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if failed["n"]:
        raise QualityGateError(f"DQ gate failed: {failed['report']}")


def split_quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantined)`` by blocking row rules; quarantined rows list the broken ones in ``dq_rules``.

    Duplicate keys are no row fault: curation keeps their newest version.
    """
    flags = F.array(*[F.when(r.failed, F.lit(r.rule_id)) for r in rules if r.severity == FAIL])
    marked = df.withColumn("dq_rules", F.filter(flags, lambda x: x.isNotNull()))
    return marked.filter(F.size("dq_rules") == 0).drop("dq_rules"), marked.filter(F.size("dq_rules") > 0)


def orphan_rows(child: DataFrame, parent: DataFrame, foreign_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent. A hot foreign key is split by adaptive skew handling (the child side streams)."""
    keys = parent.select(F.col(parent_key).alias(foreign_key))
    return child.join(keys, foreign_key, "left_anti")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, missing, total`` in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(fx.is_blank(c)).alias(f"_n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("missing"), F.col("total").alias("total"))
        for i, c in enumerate(columns)
    ])
    return counted.select(F.inline(rows))


def ingest_status(reports: DataFrame) -> DataFrame:
    """Operator view of runs from rule results with ``started_at`` and ``completed_at``."""
    return (
        reports.groupBy("run_id")
        .agg(
            F.max("record_count").alias("records_ingested"),
            F.count_if(F.col("outcome") == PASS).alias("dq_pass"),
            F.count_if(F.col("outcome") == WARN).alias("dq_warn"),
            F.count_if(F.col("outcome") == FAIL).alias("dq_fail"),
            F.min("started_at").alias("started_at"),
            F.max("completed_at").alias("completed_at"),
        )
        .withColumn("status", F.when(F.col("dq_fail") > 0, "failed").otherwise("completed"))
    )
