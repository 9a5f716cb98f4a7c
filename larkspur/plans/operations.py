"""Registered queries: timelines, service metrics, distributions and the streaming jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import metrics as mt
from larkspur.operators import reports as rp
from larkspur.operators.asof import timeline_steps
from larkspur.operators.lake import Lake
from larkspur.operators.quantiles import exact_quantiles
from larkspur.plans.answers import event_lines
from larkspur.plans.curation import GOOD_SQL
from larkspur.plans.data import INGESTED_AT, LOG_SQL, VERSION, delivered_articles, query_log, table
from larkspur.plans.register import new_register
from larkspur.session import workspace
from larkspur.sources.specs import ARTICLES
from larkspur.sources.tables import KeyedTable
from larkspur.streaming import jobs, state

QUERIES, ORACLES, query = new_register()


@query("timeline_steps", """
SELECT event_id, user_id, ts, CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1000) AS BIGINT) AS elapsed_ms,
  CAST(floor((epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts))) / 1000) AS BIGINT) AS step_ms FROM events""")
def q_timeline_steps(spark, sf_dir):
    """Events of each user as steps of one question."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return timeline_steps(events, "user_id", "ts", "event_id")


@query("slo_success", "WITH" + LOG_SQL + """
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved,
  count(*) FILTER (WHERE status = 'approved') / count(*) AS success_ratio FROM query_log WHERE status <> 'blocked' GROUP BY 1""")
def q_slo_success(spark, sf_dir):
    return mt.success_ratio(query_log(spark, sf_dir))


@query("slo_success_sliding", "WITH" + LOG_SQL + """
SELECT time_bucket(INTERVAL 1 MINUTES, ts) - to_minutes(CAST(back AS INTEGER)) AS window_start, count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved,
  count(*) FILTER (WHERE status = 'approved') / count(*) AS success_ratio FROM query_log, range(5) r(back) GROUP BY 1""")
def q_slo_success_sliding(spark, sf_dir):
    """Five-minute ratio every minute, blocked questions included."""
    return mt.success_ratio(query_log(spark, sf_dir), count_blocked=True, slide="1 minute")


@query("volume_by_status", "WITH" + LOG_SQL + """
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, status, count(*) AS n, count(*) / 300 AS per_second FROM query_log GROUP BY 1, 2""")
def q_volume_by_status(spark, sf_dir):
    return mt.volume_by_status(query_log(spark, sf_dir))


def _quantile_sql(keys: str) -> str:
    group = f"{keys}, " if keys else ""
    partition = f"PARTITION BY {keys}" if keys else ""
    return f"""
bounds(i, lo, hi) AS (VALUES (0, 0.0, 0.5), (1, 0.5, 1.0), (2, 1.0, 2.0), (3, 2.0, 5.0), (4, 5.0, 10.0), (5, 10.0, 20.0), (6, 20.0, 30.0), (7, 30.0, 60.0), (8, 60.0, 120.0), (9, 120.0, 120.0)),
b AS (SELECT {group}CASE WHEN duration_s <= 0.5 THEN 0 WHEN duration_s <= 1 THEN 1 WHEN duration_s <= 2 THEN 2 WHEN duration_s <= 5 THEN 3 WHEN duration_s <= 10 THEN 4
    WHEN duration_s <= 20 THEN 5 WHEN duration_s <= 30 THEN 6 WHEN duration_s <= 60 THEN 7 WHEN duration_s <= 120 THEN 8 ELSE 9 END AS i, count(*) AS n
  FROM (SELECT *, time_bucket(INTERVAL 5 MINUTES, ts) AS window_start FROM query_log) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER ({partition} ORDER BY i) AS cum, sum(n) OVER ({partition}) AS total FROM b),
q AS (SELECT {group}p AS probability, CAST(total AS BIGINT) AS queries,
    CAST(CASE WHEN i = 9 THEN 120.0 ELSE lo::DOUBLE + (hi::DOUBLE - lo::DOUBLE) * ((p * total - (cum - n)) / n) END AS DOUBLE) AS latency_s
  FROM c JOIN bounds USING (i), (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS p) WHERE cum >= p * total AND cum - n < p * total)"""


@query("latency_quantiles", "WITH" + LOG_SQL + "," + _quantile_sql("window_start") + """
SELECT window_start, probability, queries, round(latency_s, 6) AS latency_s FROM q""")
def q_latency_quantiles(spark, sf_dir):
    out = mt.latency_quantiles(query_log(spark, sf_dir), [0.5, 0.95, 0.99], ts="ts")
    return out.withColumn("latency_s", F.round("latency_s", 6))


@query("latency_quantiles_total", "WITH" + LOG_SQL + "," + _quantile_sql("") + " SELECT probability, queries, round(latency_s, 6) AS latency_s FROM q")
def q_latency_quantiles_total(spark, sf_dir):
    return mt.latency_quantiles(query_log(spark, sf_dir), [0.5, 0.95, 0.99]).withColumn("latency_s", F.round("latency_s", 6))


@query("latency_exact", "WITH" + LOG_SQL + """
SELECT status, 0.5::DOUBLE AS probability, round(quantile_cont(duration_s, 0.5), 6) AS quantile FROM query_log GROUP BY 1
UNION ALL SELECT status, 0.95::DOUBLE, round(quantile_cont(duration_s, 0.95), 6) FROM query_log GROUP BY 1""")
def q_latency_exact(spark, sf_dir):
    out = exact_quantiles(query_log(spark, sf_dir), ["status"], "duration_s", [0.5, 0.95])
    return out.withColumn("quantile", F.round("quantile", 6))


@query("dq_violation_rate", "WITH" + LOG_SQL + """
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, rule, count(*) AS n, count(*) / 300 AS per_second FROM query_log WHERE rule IS NOT NULL GROUP BY 1, 2""")
def q_dq_violation_rate(spark, sf_dir):
    return mt.violation_rate(query_log(spark, sf_dir))


@query("dq_violation_totals", "WITH" + LOG_SQL + " SELECT rule, count(*) AS violations FROM query_log WHERE rule IS NOT NULL GROUP BY 1")
def q_dq_violation_totals(spark, sf_dir):
    return mt.violation_totals(query_log(spark, sf_dir))


@query("total_queries", "SELECT count(*) AS total_queries FROM events")
def q_total_queries(spark, sf_dir):
    return mt.total_queries(query_log(spark, sf_dir))


@query("ingested_by_source", "SELECT source AS source_name, count(*) AS records FROM documents GROUP BY 1")
def q_ingested_by_source(spark, sf_dir):
    return mt.ingested_by_source(table(spark, sf_dir, "documents").select(F.col("source").alias("source_name")))


@query("slo_status", "WITH" + LOG_SQL + "," + _quantile_sql("") + """,
s AS (SELECT count(*) FILTER (WHERE status = 'approved') / count(*) FILTER (WHERE status <> 'blocked') AS success, CAST(count(rule) AS DOUBLE) AS violations FROM query_log)
SELECT 'success_ratio' AS metric, round(success, 6) AS value, CASE WHEN success < 0.8 THEN 'red' WHEN success < 0.95 THEN 'yellow' ELSE 'green' END AS band FROM s
UNION ALL SELECT 'p95_latency_s', round(latency_s, 6), CASE WHEN latency_s < 10 THEN 'green' WHEN latency_s < 30 THEN 'yellow' ELSE 'red' END FROM q WHERE probability = 0.95
UNION ALL SELECT 'dq_violations', violations, CASE WHEN violations < 1 THEN 'green' WHEN violations < 10 THEN 'yellow' ELSE 'red' END FROM s""")
def q_slo_status(spark, sf_dir):
    return mt.slo_status(query_log(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("recent_queries", """
SELECT event_id AS query_id, ts, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS position,
  CAST(CASE WHEN row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 50 THEN row_number() OVER (ORDER BY ts DESC, event_id DESC) END AS INTEGER) AS display_no
FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)""")
def q_recent_queries(spark, sf_dir):
    return rp.recent_queries(table(spark, sf_dir, "events"), "event_id", "ts")


@query("load_acceptance", """
WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 502 ELSE 200 END AS http_status, CASE WHEN event_type = 'signup' THEN 0 ELSE 5 END AS citations, value FROM events)
SELECT count(*) AS requests, round(count(*) FILTER (WHERE http_status = 200 AND citations > 0) / count(*), 6) AS success_rate, round(quantile_cont(value, 0.95), 6) AS p95_s,
  count(*) FILTER (WHERE http_status = 200 AND citations > 0) / count(*) >= 0.95 AND quantile_cont(value, 0.95) <= 30 AS accepted FROM r""")
def q_load_acceptance(spark, sf_dir):
    """Events as a request log: errors failed, signups came back without citations."""
    requests = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", 502).otherwise(200).alias("http_status"),
        F.when(F.col("event_type") == "signup", 0).otherwise(5).alias("citations"), "value",
    )
    out = mt.load_acceptance(requests, exact_quantiles(requests, [], "value", [0.95]))
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "p95_s")})


@query("language_distribution", """
SELECT lang, count(*) AS documents, round(count(*) / sum(count(*)) OVER (), 6) AS share,
  (SELECT count(*) FILTER (WHERE lang <> 'en') / count(*) FROM documents) > 0.3 AS high_foreign_share FROM documents GROUP BY 1""")
def q_language_distribution(spark, sf_dir):
    return mt.language_distribution(table(spark, sf_dir, "documents"), limit=0.3).withColumn("share", F.round("share", 6))


@query("status_distribution", """
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, o_orderstatus AS status, count(*) AS trials FROM orders GROUP BY 1, 2),
s AS (SELECT *, trials / sum(trials) OVER (PARTITION BY run) AS share FROM c),
d AS (SELECT *, share - lag(share) OVER (PARTITION BY status ORDER BY run) AS change FROM s)
SELECT run, status, trials, round(share, 6) AS share, round(change, 6) AS change, coalesce(abs(change) > 0.1, false) AS spike FROM d""")
def q_status_distribution(spark, sf_dir):
    """Months of orders as runs."""
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.col("o_orderstatus").alias("status"))
    return mt.status_distribution(orders).withColumns({c: F.round(c, 6) for c in ("share", "change")})


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("stream_slo", "WITH" + LOG_SQL + """
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved,
  count(*) FILTER (WHERE status = 'approved') / count(*) AS success_ratio FROM query_log WHERE status <> 'blocked' GROUP BY 1
HAVING window_start + INTERVAL 5 MINUTES <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES FROM query_log)""")
def q_stream_slo(spark, sf_dir):
    """Windows that the watermark has passed once all events are read."""
    base = workspace(spark, "stream-slo")
    status = F.when(F.col("event_type").isin("view", "click", "purchase"), "approved").when(F.col("event_type") == "signup", "rejected").when(F.col("value") > 50, "blocked").otherwise("error")
    log = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    jobs.stream_slo(log, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


VISITS_SQL = """
WITH steps AS (
  SELECT CAST(user_id AS VARCHAR) AS query_id, event_id, ts, CASE event_type WHEN 'view' THEN 'cmo_router' WHEN 'click' THEN 'peer_reviewer' ELSE 'custom_step' END AS node
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES AS passed FROM steps),
split AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY query_id ORDER BY ts, event_id) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM steps),
visits AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY ts, event_id) AS visit FROM split)"""


def _line_stream(spark, sf_dir: str, base: str) -> DataFrame:
    """Step event lines written as files, as a stream."""
    lines = event_lines(spark, sf_dir).select("ts", "line")
    lines.write.parquet(f"{base}/in")
    return spark.readStream.schema(lines.schema).parquet(f"{base}/in").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_events", VISITS_SQL + """
SELECT query_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS elapsed_ms
FROM visits GROUP BY query_id, visit HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT passed FROM mark)""")
def q_stream_events(spark, sf_dir):
    """Visits of each query that the watermark has closed; the state of the others is still open."""
    base = workspace(spark, "stream-events")
    jobs.stream_step_events(_line_stream(spark, sf_dir, base), f"{base}/out", f"{base}/checkpoint", idle="6 hours").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("stream_step_times", VISITS_SQL + """
SELECT query_id, row_number() OVER v AS step_no, node, ts, CAST(floor((epoch_us(ts) - epoch_us(first(ts) OVER v)) / 1000) AS BIGINT) AS elapsed_ms,
  CAST(floor((epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER v, ts))) / 1000) AS BIGINT) AS step_ms
FROM visits WHERE ts <= (SELECT passed FROM mark) WINDOW v AS (PARTITION BY query_id, visit ORDER BY ts, event_id)""")
def q_stream_step_times(spark, sf_dir):
    """Number and times of every step that the watermark has passed, from keyed state with timers."""
    base = workspace(spark, "stream-steps")
    state.stream_step_times(_line_stream(spark, sf_dir, base), f"{base}/out", f"{base}/checkpoint", idle_ms=6 * 3_600_000).awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_uniqueness", GOOD_SQL + """,
again AS (SELECT trim(pmid, ' ') AS k FROM delivered UNION ALL SELECT trim(pmid, ' ') FROM delivered WHERE lang = 'de' UNION ALL SELECT trim(pmid, ' ') FROM delivered WHERE source = 'src1')
SELECT 'DQ-PUB-CUR-1' AS rule_id, 'FAIL' AS severity, k AS record_id, 'Duplicate pmid found: ' || k AS message, count(*) AS copies FROM again WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1""")
def q_stream_uniqueness(spark, sf_dir):
    """Three deliveries, an hour apart, of which the later two repeat records of the first: repeated ids over all micro-batches."""
    base = workspace(spark, "stream-unique")
    delivered = delivered_articles(spark, sf_dir).select("pmid", F.element_at("authors", 2).alias("lang"), F.col("journal").alias("source"))
    parts = [delivered, delivered.filter("lang = 'de'"), delivered.filter("source = 'src1'")]
    for hour, part in enumerate(parts):
        part.select("pmid", F.lit(dt.datetime(2024, 5, 1, 12 + hour)).alias("delivered_at")).write.mode("append").parquet(f"{base}/in")
    # The batches stay a few, however many splits the table has.
    files = max(8, delivered.rdd.getNumPartitions())
    stream = spark.readStream.schema("pmid STRING, delivered_at TIMESTAMP").option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    state.stream_uniqueness(stream, ARTICLES, "delivered_at", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return state.uniqueness_violations(spark.read.schema(state.REPEAT_SCHEMA).parquet(f"{base}/out"), ARTICLES)


@query("stream_ingest", GOOD_SQL + """
SELECT pmid, title, authors, publication_date, 'raw' AS target FROM good WHERE trim(title) <> '' AND source_version <> ''
UNION ALL SELECT pmid, title, authors, publication_date, 'rejects' FROM good WHERE trim(title) = '' OR source_version = ''
UNION ALL SELECT trim(pmid), coalesce(title, ''), source || '|' || lang, CASE WHEN lang <> 'es' THEN publication_date END, 'rejects' FROM delivered
  WHERE trim(coalesce(pmid, ''), chr(9) || ' ') = ''""")
def q_stream_ingest(spark, sf_dir):
    """The delivery as JSON line files, ingested in three batches of files in quarantine mode."""
    base = workspace(spark, "stream-ingest")
    delivered = delivered_articles(spark, sf_dir)
    # At least three files, else as many as the table has splits, in three batches.
    files = max(3, delivered.rdd.getNumPartitions())
    delivered.repartition(files).write.json(f"{base}/in")
    lake = Lake(spark, f"{base}/lake")
    stream = spark.readStream.schema(ARTICLES.input_schema()).option("maxFilesPerTrigger", -(-files // 3)).json(f"{base}/in")
    jobs.stream_ingest(stream, lake, ARTICLES, VERSION, INGESTED_AT, f"{base}/checkpoint").awaitTermination()
    columns = ["pmid", "title", F.array_join("authors", "|").alias("authors"), "publication_date"]
    raw = lake.raw(ARTICLES).read().select(*columns, F.lit("raw").alias("target"))
    return raw.unionByName(lake.rejects(ARTICLES).read().select(*columns, F.lit("rejects").alias("target")))


@query("stream_curate", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_stream_curate(spark, sf_dir):
    """Events written as files by type: newest event per user, merged batch by batch into buckets."""
    base = workspace(spark, "stream-curate")
    versions = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("ingested_at"), F.col("event_type").alias("ingestion_run_id"))
    versions.repartition(4, "event_type").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    curated = KeyedTable(spark, f"{base}/curated", "user_id", ["ingested_at", "ingestion_run_id", "event_id"], 16)
    jobs.stream_curate(stream, curated, f"{base}/checkpoint").awaitTermination()
    return curated.read().select("user_id", "event_id", "event_type")
