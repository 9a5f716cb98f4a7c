"""Adapters: the driver tables in the shape of operator inputs, and the same shapes in SQL for the checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.readers import BLOCK_TAGS, read_table

INGESTED_AT = dt.datetime(2024, 5, 1, 12, 0, 0)
SNAPSHOT = "snap-1"
VERSION = "1.0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def delivered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as delivered article records: two sources send no usable id, one no title, dates come in four forms."""
    docs = table(spark, sf_dir, "documents")
    pmid = (
        F.when(F.col("source") == "src7", F.lit("  ")).when(F.col("source") == "src13", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("\t")))
    )
    return docs.select(
        pmid.alias("pmid"),
        F.when(F.col("source") == "src3", F.lit(" ")).otherwise(title_line()).alias("title"),
        body_text().alias("abstract"), F.array("source", "lang").alias("authors"), delivered_date().alias("publication_date"),
        F.col("source").alias("journal"), F.when(F.col("lang") != "es", "v1").alias("source_version"),
        F.lit("file:documents").alias("source_uri"),
    )


def delivered_date() -> Column:
    """Date text of a document, in the form its language uses; the Spanish form is no partial ISO date."""
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("n_chars") % 3650).cast("int"))
    return (
        F.when(F.col("lang") == "en", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("lang") == "de", F.date_format(day, "yyyy-MM"))
        .when(F.col("lang") == "fr", F.date_format(day, "yyyy"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )


def title_line() -> Column:
    return F.substring_index("text", "\n", 1)


def body_text() -> Column:
    newline = F.instr(F.col("text"), "\n")
    return F.when(newline > 0, F.substring(F.col("text"), newline + 1, F.length("text")))


def curated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as curated articles; Spanish documents have no readable date."""
    docs = table(spark, sf_dir, "documents")
    date = F.when(F.col("lang") != "es", delivered_date())
    return docs.select(
        F.col("doc_id").cast("string").alias("pmid"), title_line().alias("title"), body_text().alias("abstract"),
        date.alias("publication_date"), F.col("source").alias("journal"), F.lit(SNAPSHOT).alias("snapshot_ref"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials: part types are conditions, part names interventions, quantities the sample.

    Lines meet by order before they get the texts of their parts: where parts are sent to all tasks, no text is shuffled.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    per_order = (
        lines.repartition("l_orderkey").join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.array_sort(F.collect_set("p_type")).alias("conditions"),
            F.array_sort(F.collect_set("p_name")).alias("interventions"),
            F.array_sort(F.collect_set("l_returnflag")).alias("primary_outcomes"),
            F.sum("l_quantity").cast("int").alias("sample_size"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return orders.join(per_order, "o_orderkey", "left").select(
        F.concat(F.lit("NCT"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0")).alias("nct_id"),
        F.concat(F.lit("Study "), F.col("o_orderpriority")).alias("brief_title"),
        "conditions", "interventions", "primary_outcomes", "sample_size", F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.date_format("last_ship", "yyyy-MM").alias("completion_date"),
        F.lit(SNAPSHOT).alias("snapshot_ref"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions.

    Short ones ask a registry that holds nothing, the next ones name trials, then studies; the longest carry dates.
    """
    size = F.length("text")
    lead = (
        F.when(size < 130, F.lit("What is ")).when(size < 190, F.lit("Which clinical trials report: "))
        .when(size < 240, F.lit("Is there a study about ")).otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(lead, F.col("text")).alias("question"),
        F.when(size < 130, F.lit("registry")).alias("source_type"),
        F.when(size > 300, F.lit("2016-03-01")).cast("date").alias("date_from"),
        F.when(size > 330, F.lit("2019-06-30")).cast("date").alias("date_to"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a question log: status from the event type, value as seconds, errors name the broken rule."""
    status = (
        F.when(F.col("event_type").isin("view", "click", "purchase"), "approved")
        .when(F.col("event_type") == "signup", "rejected").when(F.col("value") > 50, "blocked").otherwise("error")
    )
    rule = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "DQ-UI-1").otherwise("DQ-UI-2"))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", status.alias("status"), F.col("value").alias("duration_s"), rule.alias("rule")
    )


ARTICLES_SQL = """
article_base AS (
  SELECT *, CASE lang WHEN 'en' THEN strftime(published, '%Y-%m-%d') WHEN 'de' THEN strftime(published, '%Y-%m')
      WHEN 'fr' THEN strftime(published, '%Y') ELSE strftime(published, '%d/%m/%Y') END AS delivered_date,
    split_part(text, chr(10), 1) AS first_line,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS rest
  FROM (SELECT *, DATE '2015-01-01' + CAST(n_chars % 3650 AS INTEGER) AS published FROM documents)),
delivered AS (
  SELECT CASE WHEN source = 'src7' THEN '  ' WHEN source = 'src13' THEN NULL ELSE ' ' || doc_id || chr(9) END AS pmid,
    CASE WHEN source = 'src3' THEN ' ' ELSE first_line END AS title, rest AS abstract, source, lang,
    delivered_date AS publication_date, source AS journal,
    CASE WHEN lang <> 'es' THEN 'v1' END AS source_version, 'file:documents' AS source_uri
  FROM article_base),
articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmid, first_line AS title, rest AS abstract,
    CASE WHEN lang <> 'es' THEN delivered_date END AS publication_date, source AS journal, 'snap-1' AS snapshot_ref
  FROM article_base)"""

TRIALS_SQL = """
trials AS (
  SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS nct_id, 'Study ' || o_orderpriority AS brief_title,
    conditions, interventions, primary_outcomes, sample_size, o_orderstatus AS status,
    strftime(o_orderdate, '%Y-%m-%d') AS start_date, strftime(last_ship, '%Y-%m') AS completion_date,
    'snap-1' AS snapshot_ref
  FROM orders LEFT JOIN (
    SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS conditions, list_sort(list(DISTINCT p_name)) AS interventions,
      list_sort(list(DISTINCT l_returnflag)) AS primary_outcomes, CAST(sum(l_quantity) AS INTEGER) AS sample_size,
      max(l_shipdate) AS last_ship
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""

QUESTIONS_SQL = """
questions AS (
  SELECT item_id AS query_id,
    CASE WHEN length(text) < 130 THEN 'What is ' WHEN length(text) < 190 THEN 'Which clinical trials report: '
      WHEN length(text) < 240 THEN 'Is there a study about ' ELSE '' END || text AS question,
    CASE WHEN length(text) < 130 THEN 'registry' END AS given_type,
    CASE WHEN length(text) > 300 THEN DATE '2016-03-01' END AS date_from,
    CASE WHEN length(text) > 330 THEN DATE '2019-06-30' END AS date_to
  FROM benchmark)"""

LOG_SQL = """
query_log AS (
  SELECT event_id, ts, user_id,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'approved' WHEN event_type = 'signup' THEN 'rejected'
      WHEN value > 50 THEN 'blocked' ELSE 'error' END AS status,
    value AS duration_s,
    CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'DQ-UI-1' ELSE 'DQ-UI-2' END END AS rule
  FROM events)"""


def page_text_sql(html: str) -> str:
    """The text of a page in SQL."""
    attributes = """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{BLOCK_TAGS})\\b{attributes}>', chr(10), 'g')"
    out = f"replace(regexp_replace({out}, '<[A-Za-z/!]{attributes}>', '', 'g'), '&nbsp;', ' ')"
    out = f"trim(regexp_replace(regexp_replace({out}, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{letter}')"
    return f"nullif({out}, '')"
