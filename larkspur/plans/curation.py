"""Registered queries: scans, normalisation, snapshots, dedup and data quality."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.operators import quality as dq
from larkspur.operators.dedup import duplicate_keys, latest_per_key, merge_newest, newest_version
from larkspur.operators.index import IndexRun
from larkspur.operators.ingest import IngestRun, run_counts
from larkspur.operators.lake import Lake, curate_runs, index_changes, ingest_run
from larkspur.operators.normalise import mark_rejects, normalise_articles, normalise_trials, project_curated, split_rejects
from larkspur.plans.data import (
    ARTICLES_SQL, INGESTED_AT, SNAPSHOT, TRIALS_SQL, VERSION, body_text, delivered_articles, delivered_date, page_text_sql, table, trials,
)
from larkspur.plans.register import new_register
from larkspur.session import workspace
from larkspur.sources.readers import article_text_from_xml, page_text, read_source_json, trial_text_from_json
from larkspur.sources.snapshots import SnapshotStore
from larkspur.sources.specs import ARTICLES, TRIALS

QUERIES, ORACLES, query = new_register()


VALID_DATE_SQL = """CASE WHEN regexp_full_match(v, '[0-9]{4}(-[0-9]{1,2}(-[0-9]{1,2})?)?') AND left(v, 4) <> '0000'
      AND (CASE WHEN len(string_split(v, '-')) = 1 THEN true
        WHEN len(string_split(v, '-')) = 2 THEN CAST(split_part(v, '-', 2) AS INTEGER) BETWEEN 1 AND 12
        ELSE try_strptime(v, '%Y-%m-%d') IS NOT NULL END) THEN v END"""

GOOD_SQL = "WITH" + ARTICLES_SQL + """,
good AS (
  SELECT trim(pmid, chr(9) || ' ') AS pmid, coalesce(title, '') AS title, abstract, source || '|' || lang AS authors,
    CASE WHEN lang <> 'es' THEN publication_date END AS publication_date, journal,
    'pubmed' AS source_name, coalesce(source_version, '') AS source_version, source_uri,
    'run-1' AS ingestion_run_id, '1.0.0' AS pipeline_version
  FROM delivered WHERE trim(coalesce(pmid, ''), chr(9) || ' ') <> '')
"""


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = split_rejects(delivered_articles(spark, sf_dir), ARTICLES)
    return normalise_articles(good, "run-1", VERSION, INGESTED_AT)


@query("normalise_articles", GOOD_SQL + "SELECT * FROM good")
def q_normalise_articles(spark, sf_dir):
    return _good(spark, sf_dir).withColumn("authors", F.array_join("authors", "|")).drop("ingested_at")


@query("split_rejects", "WITH" + ARTICLES_SQL + """
SELECT title, journal, 'Record is missing required field ''pmid''' AS parse_error FROM delivered
WHERE trim(coalesce(pmid, ''), chr(9) || ' ') = ''""")
def q_split_rejects(spark, sf_dir):
    _, rejected = split_rejects(delivered_articles(spark, sf_dir), ARTICLES)
    return rejected.select("title", "journal", "parse_error")


@query("run_counts", "WITH" + ARTICLES_SQL + """
SELECT count(*) AS records_in, count(*) FILTER (WHERE trim(coalesce(pmid, ''), chr(9) || ' ') <> '') AS parsed,
  count(*) FILTER (WHERE trim(coalesce(pmid, ''), chr(9) || ' ') = '') AS rejected FROM delivered""")
def q_run_counts(spark, sf_dir):
    return run_counts(mark_rejects(delivered_articles(spark, sf_dir), ARTICLES))


_TRIAL_COLUMNS_SQL = """nct_id, brief_title, coalesce(array_to_string(conditions, '|'), '') AS conditions,
  coalesce(array_to_string(interventions, '|'), '') AS interventions,
  coalesce(array_to_string(primary_outcomes, '|'), '') AS primary_outcomes, sample_size, status, start_date, completion_date"""


def _flat_trials(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in ("conditions", "interventions", "primary_outcomes")})


@query("normalise_trials", "WITH" + TRIALS_SQL + f"""
SELECT {_TRIAL_COLUMNS_SQL}, 'clinicaltrials' AS source_name, '' AS source_version, '' AS source_uri FROM trials""")
def q_normalise_trials(spark, sf_dir):
    shaped = normalise_trials(trials(spark, sf_dir).drop("snapshot_ref"), "run-1", VERSION, INGESTED_AT)
    return _flat_trials(shaped).drop("ingested_at", "ingestion_run_id", "pipeline_version")


@query("curate_trials", "WITH" + TRIALS_SQL + f"""
SELECT {_TRIAL_COLUMNS_SQL}, CASE WHEN status = 'P' THEN 'run-2' ELSE 'run-1' END AS ingestion_run_id,
  '["' || array_to_string(conditions, '","') || '"]' AS conditions_json FROM trials""")
def q_curate_trials(spark, sf_dir):
    """All trials in a first run; pending ones again in a later run, which wins."""
    records = trials(spark, sf_dir).drop("snapshot_ref")
    first = normalise_trials(records, "run-1", VERSION, INGESTED_AT)
    later = normalise_trials(records.filter("status = 'P'"), "run-2", VERSION, INGESTED_AT + dt.timedelta(days=1))
    curated = project_curated(merge_newest(first, later, "nct_id"), TRIALS, INGESTED_AT)
    as_json = F.when(F.size("conditions") > 0, fx.json_list("conditions"))
    flat = _flat_trials(curated.withColumn("conditions_json", as_json))
    return flat.select(*TRIALS.curated_schema.names[:9], "ingestion_run_id", "conditions_json")


@query("ingest_roundtrip", GOOD_SQL + """
SELECT pmid, title, coalesce(abstract, '') AS abstract, authors, publication_date, journal, 0 AS snippet_count,
  ingestion_run_id FROM good WHERE trim(title) <> '' AND source_version <> '' AND source_uri <> ''""")
def q_ingest_roundtrip(spark, sf_dir):
    """Write the delivery as JSON lines, ingest it in quarantine mode, curate it and read the curated table."""
    base = workspace(spark, "ingest")
    delivered_articles(spark, sf_dir).write.json(f"{base}/delivery")
    lake = Lake(spark, f"{base}/lake", buckets=16)
    records = read_source_json(spark, f"{base}/delivery", ARTICLES, lines=True)
    ingest_run(lake, records, ARTICLES, IngestRun("run-1", VERSION, INGESTED_AT, mode="quarantine"))
    curate_runs(lake, ARTICLES, ["run-1"], INGESTED_AT)
    return lake.curated(ARTICLES).read().select(
        "pmid", "title", F.coalesce("abstract", F.lit("")).alias("abstract"), F.array_join("authors", "|").alias("authors"),
        "publication_date", "journal", "snippet_count", "ingestion_run_id",
    )


def _as_array(lines):
    """The lines of a task, which become one file, between the brackets of an array."""
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    yield from lines
    yield pa.RecordBatch.from_pydict({"value": ["null]"]})


@query("read_arrays", "WITH" + ARTICLES_SQL + """
SELECT pmid, title, md5(abstract) AS abstract_md5, source || '|' || lang AS authors, publication_date, source_version FROM delivered""")
def q_read_arrays(spark, sf_dir):
    """The delivery as JSON array files, read record by record."""
    base = workspace(spark, "arrays")
    records = delivered_articles(spark, sf_dir)
    rows = records.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value"))
    rows.mapInArrow(_as_array, "value string").write.option("lineSep", "\n").text(f"{base}/in")
    return read_source_json(spark, f"{base}/in", ARTICLES).select(
        "pmid", "title", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", "|").alias("authors"), "publication_date", "source_version"
    )


@query("lake_refresh", GOOD_SQL + """,
fit AS (SELECT * FROM good WHERE (trim(title) <> '' OR journal IN ('src1', 'src2')) AND source_version <> '' AND source_uri <> ''),
newest AS (
  SELECT 'PMID:' || pmid AS doc_id, CASE WHEN journal IN ('src1', 'src2') THEN 'Revised: ' || title ELSE title END AS title,
    CASE WHEN journal IN ('src1', 'src2') THEN 'run-2' ELSE 'run-1' END AS ingestion_run_id FROM fit)
SELECT doc_id, title, replace(ingestion_run_id, 'run', 'index') AS indexing_run_id, replace(ingestion_run_id, 'run', 'snap') AS snapshot_ref, CAST(64 AS INTEGER) AS dimension FROM newest""")
def q_lake_refresh(spark, sf_dir):
    """Two deliveries, the second with revised titles of two journals: each is ingested, curated and indexed by itself, and the later run
    is curated first. Only what a delivery changed is embedded."""
    lake = Lake(spark, workspace(spark, "lake"), buckets=16)
    delivered = delivered_articles(spark, sf_dir)
    revised = delivered.filter("journal IN ('src1', 'src2')").withColumn("title", F.concat(F.lit("Revised: "), F.coalesce("title", F.lit(""))))
    for no, part in ((2, revised), (1, delivered)):
        at = INGESTED_AT + dt.timedelta(days=no)
        ingest_run(lake, part, ARTICLES, IngestRun(f"run-{no}", VERSION, at, mode="quarantine"))
        changed = curate_runs(lake, ARTICLES, [f"run-{no}"], at)
        index_changes(lake, ARTICLES, changed, f"snap-{no}", IndexRun(f"index-{no}"), at)
    return lake.index(ARTICLES).read().select("doc_id", "title", "indexing_run_id", "snapshot_ref", F.size("vector").alias("dimension"))


def _event_days(spark: SparkSession, sf_dir: str) -> tuple[SnapshotStore, DataFrame]:
    """Events in three snapshots: up to day 10, up to day 20, all."""
    store = SnapshotStore(spark, workspace(spark, "snapshots"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for day, name in ((10, "s1"), (20, "s2"), (31, "s3")):
        at = dt.datetime(2024, 1, day)
        store.write("events", events.filter(F.col("ts") < F.lit(str(at)).cast("timestamp_ntz")), name, at)
    return store, events


@query("read_as_of", """
SELECT 's2' AS snapshot_id, event_type, count(*) AS events, round(sum(value), 2) AS total
FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY event_type""")
def q_read_as_of(spark, sf_dir):
    store, _ = _event_days(spark, sf_dir)
    at = dt.datetime(2024, 1, 25)
    return store.read("events", as_of=at).groupBy("event_type").agg(
        F.lit(store.latest_snapshot_id("events", at)).alias("snapshot_id"), F.count(F.lit(1)).alias("events"),
        F.round(F.sum("value"), 2).alias("total"),
    )


@query("rollback_table", """
SELECT 's1' AS snapshot_id, event_type, count(*) AS events FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY event_type""")
def q_rollback_table(spark, sf_dir):
    store, _ = _event_days(spark, sf_dir)
    store.rollback("events", "s1", dt.datetime(2024, 2, 1))
    return store.read("events").groupBy("event_type").agg(
        F.lit(store.latest_snapshot_id("events")).alias("snapshot_id"), F.count(F.lit(1)).alias("events")
    )


@query("list_datasets", """
SELECT * FROM (VALUES ('events', 's3', 'event_id', 'bigint', 0), ('events', 's3', 'ts', 'timestamp_ntz', 1),
  ('events', 's3', 'user_id', 'bigint', 2), ('events', 's3', 'event_type', 'string', 3), ('events', 's3', 'value', 'double', 4))
  v(table_name, snapshot_id, column_name, data_type, position) WHERE EXISTS (SELECT 1 FROM events)""")
def q_list_datasets(spark, sf_dir):
    store, _ = _event_days(spark, sf_dir)
    return store.list_datasets()


@query("safe_int", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_text,
  TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_variant, CAST(NULL AS INTEGER) AS value_text,
  TRY_CAST(event_type AS INTEGER) AS type_text FROM events""")
def q_safe_int(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.variant_get(F.try_parse_json("props"), "$.k", "variant")
    return events.withColumn("k", k).select(
        "event_id", fx.safe_int(F.get_json_object("props", "$.k")).alias("k_text"),
        fx.safe_int("k", variant=True).alias("k_variant"),
        fx.safe_int(F.format_string("%.2f", "value")).alias("value_text"), fx.safe_int("event_type").alias("type_text"),
    )


_DATES_SQL = """
WITH d AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m')
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m') || '-31' ELSE strftime(o_orderdate, '%Y') END AS v,
    CASE o_orderstatus WHEN 'P' THEN true ELSE false END AS padded FROM orders),
n AS (SELECT o_orderkey, """ + VALID_DATE_SQL + """ AS partial_date FROM d)
SELECT o_orderkey, partial_date,
  CAST(CASE len(string_split(partial_date, '-')) WHEN 1 THEN partial_date || '-01-01' WHEN 2 THEN partial_date || '-01'
    ELSE strftime(strptime(partial_date, '%Y-%m-%d'), '%Y-%m-%d') END AS VARCHAR) AS first_day,
  CASE len(string_split(partial_date, '-')) WHEN 1 THEN partial_date || '-12-31'
    WHEN 2 THEN strftime(last_day(CAST(partial_date || '-01' AS DATE)), '%Y-%m-%d')
    ELSE strftime(strptime(partial_date, '%Y-%m-%d'), '%Y-%m-%d') END AS last_day FROM n"""


@query("partial_iso_date", _DATES_SQL)
def q_partial_iso_date(spark, sf_dir):
    day = "o_orderdate"
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "yyyy-M-d"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "yyyy-MM"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.date_format(day, "yyyy-MM"), F.lit("-31")))
        .otherwise(F.date_format(day, "yyyy"))
    )
    padded = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("\t "), text, F.lit("\n"))).otherwise(text)
    dated = table(spark, sf_dir, "orders").select("o_orderkey", fx.partial_iso_date(padded).alias("partial_date"))
    return dated.select(
        "o_orderkey", "partial_date", fx.date_lower("partial_date").cast("string").alias("first_day"),
        fx.date_upper("partial_date").cast("string").alias("last_day"),
    )


_NORMALISED_SQL = GOOD_SQL.rstrip() + """,
broken AS (
  SELECT 'DQ-PUB-CUR-2' AS rule_id, pmid AS record_id, 'title is empty for pmid=' || pmid AS message FROM good WHERE trim(title) = ''
  UNION ALL
  SELECT 'DQ-P1', pmid, 'Missing provenance fields: [''source_version'']' FROM good WHERE source_version = '')"""


@query("dq_violations_articles", _NORMALISED_SQL + " SELECT rule_id, 'FAIL' AS severity, record_id, message FROM broken")
def q_dq_violations_articles(spark, sf_dir):
    return dq.run_dq(_good(spark, sf_dir), ARTICLES)


def _report_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("failed_ids", F.array_join("failed_ids", ","))


@query("dq_report_articles", _NORMALISED_SQL + """,
rules(rule_id) AS (VALUES ('DQ-PUB-RAW-1'), ('DQ-PUB-CUR-2'), ('DQ-P1'), ('DQ-PUB-CUR-1')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY record_id) AS r FROM broken)
SELECT 'run-1' AS ingestion_run_id, r.rule_id, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome,
  coalesce(n, 0) || ' of ' || total || ' failed' AS message, total AS record_count, coalesce(n, 0) AS failed_count,
  coalesce(ids, '') AS failed_ids
FROM rules r CROSS JOIN (SELECT count(*) AS total FROM good)
LEFT JOIN (SELECT rule_id, count(*) AS n FROM broken GROUP BY 1) USING (rule_id)
LEFT JOIN (SELECT rule_id, string_agg(record_id, ',' ORDER BY record_id) AS ids FROM ranked WHERE r <= 10 GROUP BY 1) USING (rule_id)""")
def q_dq_report_articles(spark, sf_dir):
    return _report_rows(dq.dq_results(_good(spark, sf_dir), ARTICLES))


_TRIAL_DQ_SQL = "WITH" + TRIALS_SQL + """,
runs AS (SELECT * FROM (SELECT nct_id, status FROM trials UNION ALL SELECT nct_id, status FROM trials WHERE status = 'P')),
dup AS (SELECT nct_id FROM runs GROUP BY 1 HAVING count(*) > 1)"""


@query("dq_report_trials", _TRIAL_DQ_SQL + """
SELECT 'run-1' AS run_id, (SELECT count(*) FROM runs) AS total_records, true AS has_failures,
  'DQ-CT-CUR-1:FAIL:' || (SELECT count(*) FROM dup) || ';DQ-CT-RAW-1:PASS:0;DQ-P1:FAIL:' || (SELECT count(*) FROM runs) AS outcomes""")
def q_dq_report_trials(spark, sf_dir):
    """Pending trials are delivered twice in one run, and no record names its source version."""
    records = trials(spark, sf_dir).drop("snapshot_ref")
    both = records.unionByName(records.filter("status = 'P'"))
    results = dq.dq_results(normalise_trials(both, "run-1", VERSION, INGESTED_AT), TRIALS)
    report = dq.dq_report(results, VERSION, "clinicaltrials", F.lit(INGESTED_AT), snapshot_id=SNAPSHOT)
    line = F.transform("results", lambda r: F.concat_ws(":", r["rule_id"], r["outcome"], r["failed_count"].cast("string")))
    return report.select("run_id", "total_records", "has_failures", F.array_join(line, ";").alias("outcomes"))


@query("dq_any_failure", _NORMALISED_SQL + " SELECT count(*) > 0 AS has_failures FROM broken")
def q_dq_any_failure(spark, sf_dir):
    return dq.any_failure(dq.dq_results(_good(spark, sf_dir), ARTICLES))


@query("quarantine", _NORMALISED_SQL + """
SELECT pmid, string_agg(rule_id, ',' ORDER BY CASE rule_id WHEN 'DQ-PUB-CUR-2' THEN 1 ELSE 2 END) AS dq_rules
FROM broken JOIN good ON pmid = record_id GROUP BY pmid""")
def q_quarantine(spark, sf_dir):
    _, bad = dq.split_quarantine(_good(spark, sf_dir), dq.article_rules())
    return bad.select("pmid", F.array_join("dq_rules", ",").alias("dq_rules"))


@query("dq_orphans", """
SELECT 'labels' AS child, CAST(doc_id AS VARCHAR) AS record_id, count(*) AS orphans FROM labels
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 2
UNION ALL
SELECT 'lineitem', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 2""")
def q_dq_orphans(spark, sf_dir):
    """Labels of documents that are not in the English curated table, and outcomes of trials still pending."""
    english = table(spark, sf_dir, "documents").filter("lang = 'en'")
    settled = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")

    def counted(child: DataFrame, name: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
        """Children are counted per key first, so a busy key meets its parent as one row."""
        per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("orphans"))
        orphans = dq.orphan_rows(per_key, parent, key, parent_key)
        return orphans.select(F.lit(name).alias("child"), F.col(key).cast("string").alias("record_id"), "orphans")

    labels = counted(table(spark, sf_dir, "labels"), "labels", "doc_id", english, "doc_id")
    return labels.unionByName(counted(table(spark, sf_dir, "lineitem"), "lineitem", "l_orderkey", settled, "o_orderkey"))


@query("dq_warnings", "WITH" + ARTICLES_SQL + "," + TRIALS_SQL.lstrip("\n") + """
SELECT 'DQ-PUB-RAW-2' AS rule_id, CAST(doc_id AS VARCHAR) AS record_id, 'publication_date cannot be read: ' || delivered_date AS message
FROM article_base WHERE lang = 'es'
UNION ALL SELECT 'DQ-PUB-CUR-3', pmid, 'abstract is missing' FROM articles WHERE trim(coalesce(abstract, ''), chr(9) || chr(10) || chr(13) || ' ') = ''
UNION ALL SELECT 'DQ-CT-RAW-2', nct_id, 'outcomes are missing' FROM trials WHERE primary_outcomes IS NULL
UNION ALL SELECT 'DQ-CT-CUR-2', nct_id, 'sample_size is unknown' FROM trials WHERE sample_size IS NULL""")
def q_dq_warnings(spark, sf_dir):
    articles = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("pmid"), body_text().alias("abstract"), delivered_date().alias("raw_publication_date")
    )
    found = dq.row_violations(articles, dq.article_warnings(), F.col("pmid"))
    trial_rows = dq.row_violations(trials(spark, sf_dir), dq.trial_warnings(), F.col("nct_id"))
    return found.unionByName(trial_rows).drop("severity")


@query("null_counts", "WITH" + ARTICLES_SQL + """
SELECT 'abstract' AS column_name, count(*) FILTER (WHERE trim(coalesce(abstract, ''), chr(9) || chr(10) || chr(13) || ' ') = '') AS missing, count(*) AS total FROM delivered
UNION ALL SELECT 'title', count(*) FILTER (WHERE trim(coalesce(title, ''), chr(9) || chr(10) || chr(13) || ' ') = ''), count(*) FROM delivered
UNION ALL SELECT 'source_version', count(*) FILTER (WHERE source_version IS NULL), count(*) FROM delivered""")
def q_null_counts(spark, sf_dir):
    return dq.null_counts(delivered_articles(spark, sf_dir), ["abstract", "title", "source_version"])


@query("ingest_status", """
WITH runs AS (
  SELECT 'run-' || strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS records_ingested, min(ts) AS started_at, max(ts) AS completed_at,
    count(*) FILTER (WHERE event_type = 'error' AND value > 150) AS errors, count(*) FILTER (WHERE value > 250) AS slow
  FROM events GROUP BY 1)
SELECT run_id, records_ingested, CAST(1 + (errors = 0)::INT + (slow = 0)::INT AS BIGINT) AS dq_pass,
  CAST((slow > 0)::INT AS BIGINT) AS dq_warn, CAST((errors > 0)::INT AS BIGINT) AS dq_fail, started_at, completed_at,
  CASE WHEN errors > 0 THEN 'failed' ELSE 'completed' END AS status FROM runs""")
def q_ingest_status(spark, sf_dir):
    """Every day of events as a run with three rules: ids present, no slow error (blocking), nothing very slow (warning)."""
    runs = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("run-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id")).agg(
        F.count(F.lit(1)).alias("record_count"), F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"),
        F.count_if(F.col("event_id").isNull()).alias("no_id"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("errors"),
        F.count_if(F.col("value") > 250).alias("slow"),
    )
    rules = F.array(*[
        F.struct(F.lit(rule).alias("rule_id"), F.when(F.col(count) > 0, F.lit(level)).otherwise(F.lit(dq.PASS)).alias("outcome"))
        for rule, count, level in (("ID", "no_id", dq.FAIL), ("ERROR", "errors", dq.FAIL), ("SLOW", "slow", dq.WARN))
    ])
    return dq.ingest_status(runs.select("run_id", "record_count", "started_at", "completed_at", F.inline(rules)))


@query("latest_per_key", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_latest_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return latest_per_key(events, ["user_id"], [F.desc("ts")], [F.desc("event_id")])


@query("curate_articles", GOOD_SQL + """, runs AS (
  SELECT *, 1 AS run_no FROM good UNION ALL SELECT *, 2 FROM good WHERE publication_date IS NULL)
SELECT pmid, title, publication_date, 0 AS snippet_count, 'run-' || max(run_no) AS ingestion_run_id FROM runs GROUP BY pmid, title, publication_date""")
def q_curate_articles(spark, sf_dir):
    """Records without a readable date come again in a second run at the same time; the later run id wins the tie."""
    first = _good(spark, sf_dir)
    again = first.filter(F.col("publication_date").isNull()).withColumn("ingestion_run_id", F.lit("run-2"))
    newest = newest_version(first.unionByName(again), "pmid")
    return project_curated(newest, ARTICLES, INGESTED_AT).select("pmid", "title", "publication_date", "snippet_count", "ingestion_run_id")


@query("duplicate_keys", "SELECT md5(text) AS text_key, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_keys(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key")), "text_key")


@query("extract_text", f"SELECT page_id, md5({page_text_sql('html')}) AS text_md5, length({page_text_sql('html')}) AS text_chars FROM pages")
def q_extract_text(spark, sf_dir):
    """Text of whole pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))
    return pages.select("page_id", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("text_chars"))


@query("extract_article_text", """
SELECT doc_id, CASE WHEN source <> 'src3' THEN nullif(array_to_string([trim(l) FOR l IN string_split(text, chr(10)) IF trim(l) <> ''], chr(10) || chr(10)), '') END AS article_text
FROM documents""")
def q_extract_article_text(spark, sf_dir):
    """Documents staged as whole article records, one labelled abstract block per line with an element inside; one source has no numeric ids."""
    def escape(line):
        return F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    blocks = F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit('<AbstractText Label="PART" NlmCategory="x &gt; y">'), escape(line), F.lit("<sup>1</sup>, cut</AbstractText>")))
    head, title = '<?xml version="1.0"?><!DOCTYPE PubmedArticleSet PUBLIC "-//X//DTD" "https://example.org/x.dtd"><PubmedArticleSet><PubmedArticle><MedlineCitation><Article><ArticleTitle>', "</ArticleTitle><Abstract>"
    tail = "</Abstract></Article></MedlineCitation><PubmedData><Other><Text>no abstract</Text></Other></PubmedData></PubmedArticle></PubmedArticleSet>"
    xml = F.concat(F.lit(head), F.col("lang"), F.lit(title), F.array_join(blocks, ""), F.lit(tail))
    staged_id = F.concat(F.when(F.col("source") == "src3", "x").otherwise(""), F.col("doc_id").cast("string"))
    staged = table(spark, sf_dir, "documents").select("doc_id", staged_id.alias("staged_id"), xml.alias("xml"))
    return staged.select("doc_id", article_text_from_xml(F.col("staged_id"), F.col("xml")).alias("article_text"))


@query("extract_trial_text", """
SELECT conv_id, turn, CASE WHEN role <> 'system' THEN nullif(text, '') END AS trial_text FROM conversations""")
def q_extract_trial_text(spark, sf_dir):
    """Turns staged as study documents: user turns have a summary only, system turns no trial id."""
    detailed = F.when(F.col("role") == "assistant", F.col("text")).otherwise(F.lit(""))
    module = F.struct(F.struct(F.struct(detailed.alias("detailedDescription"), F.col("text").alias("briefSummary")).alias("descriptionModule")).alias("protocolSection"))
    trial_id = F.concat(F.when(F.col("role") == "system", "X").otherwise("NCT"), F.col("conv_id").cast("string"))
    staged = table(spark, sf_dir, "conversations").select("conv_id", "turn", trial_id.alias("trial_id"), F.to_json(module).alias("payload"))
    return staged.select("conv_id", "turn", trial_text_from_json(F.col("trial_id"), F.col("payload")).alias("trial_text"))
