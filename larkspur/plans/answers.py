"""Registered queries: from questions to reviewed answers, manifests and their views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.functions.render import parse_event_line
from larkspur.operators import evidence as ev
from larkspur.operators import features as ft
from larkspur.operators import index as ix
from larkspur.operators import jobs
from larkspur.operators import quality as dq
from larkspur.operators import reports as rp
from larkspur.operators.search import ClusteredVectors, cluster_vectors
from larkspur.plans.data import (
    ARTICLES_SQL, INGESTED_AT, QUESTIONS_SQL, SNAPSHOT, TRIALS_SQL, curated_articles, page_text_sql, questions, table, trials,
)
from larkspur.plans.knowledge import ARTICLE_STATS_SQL, BLANKS, TRIAL_STATS_SQL, vectors_sql
from larkspur.plans.register import new_register
from larkspur.session import application_folder, written
from larkspur.sources.readers import page_text, trial_text_from_json
from larkspur.sources.snapshots import UNKNOWN, SnapshotStore
from larkspur.sources.specs import ARTICLES, TRIALS

QUERIES, ORACLES, query = new_register()


def _sql_words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


ROUTED_SQL = f"""
routed AS (
  SELECT query_id, question, date_from, date_to, 5 AS search_limit,
    coalesce(given_type, CASE WHEN list_has_any(tokens, [{_sql_words(fx.TRIAL_WORDS)}]) THEN 'trial'
      WHEN list_has_any(tokens, [{_sql_words(fx.ARTICLE_WORDS)}]) THEN 'article' END) AS source_type,
    coalesce(nullif(array_to_string([y FOR y IN [trim(x, '.,;:?!()') FOR x IN tokens IF x NOT IN ({_sql_words(fx.STOP_WORDS)})] IF y <> ''], ' '), ''), question) AS search_query
  FROM (SELECT *, string_split_regex(trim(lower(question), {BLANKS}), '\\s+') AS tokens FROM questions))"""

INDEX_SQL = f"""
docs AS (
  SELECT 'PMID:' || pmid AS doc_id, title, coalesce(abstract, '') AS content, 'article' AS source_type, journal,
    CAST(CASE length(publication_date) WHEN 4 THEN publication_date || '-01-01' WHEN 7 THEN publication_date || '-01' ELSE publication_date END AS DATE) AS first_day,
    CASE length(publication_date) WHEN 4 THEN CAST(publication_date || '-12-31' AS DATE)
      WHEN 7 THEN last_day(CAST(publication_date || '-01' AS DATE)) ELSE CAST(publication_date AS DATE) END AS last_day,
    trim(title || ' ' || coalesce(abstract, ''), {BLANKS}) AS embedding_text FROM articles
  UNION ALL
  SELECT 'NCT:' || nct_id, brief_title, coalesce(concat_ws(' ', array_to_string(conditions, ', '), array_to_string(interventions, ', ')), ''), 'trial', NULL,
    CAST(start_date AS DATE), CAST(start_date AS DATE),
    concat_ws(' ', brief_title, array_to_string(conditions, ', '), array_to_string(interventions, ', ')) FROM trials),
question_texts AS (SELECT query_id AS doc_id, search_query AS embedding_text FROM routed)"""

PAIRS_SQL = "," + vectors_sql("docs", "dvec") + "," + vectors_sql("question_texts", "qvec") + """,
dots AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.unit * d.unit), 6) AS score FROM qvec q JOIN dvec d USING (slot) GROUP BY 1, 2),
pairs AS (
  SELECT q.query_id, d.doc_id, d.journal, coalesce(s.score, 0.0) AS score FROM routed q
  JOIN docs d ON (q.source_type IS NULL OR q.source_type = d.source_type)
    AND (q.date_from IS NULL OR q.date_from <= d.last_day) AND (q.date_to IS NULL OR q.date_to >= d.first_day)
  LEFT JOIN dots s ON s.query_id = q.query_id AND s.doc_id = d.doc_id),
top AS (SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM pairs) WHERE r <= 5)"""

HITS_SQL = f""",
staged AS (SELECT 'PMID:' || page_id AS doc_id, {page_text_sql('html')} AS fetched FROM pages
  UNION ALL SELECT 'NCT:' || nct_id, 'Status ' || status || ' for ' || array_to_string(conditions, ', ') || ' by ' || array_to_string(interventions, ', ') FROM trials),
hits AS (
  SELECT query_id, rank, doc_id, score, title, substr(content, 1, 500) AS snippet, source_type, 'snap-1' AS snapshot_ref,
    coalesce(CASE WHEN content = '' OR (starts_with(content, 'Abstract ') AND length(content) < 20) OR (source_type = 'trial' AND length(content) < 100)
      THEN fetched END, nullif(content, ''), substr(content, 1, 500)) AS content
  FROM top JOIN docs USING (doc_id) LEFT JOIN staged USING (doc_id)),
enriched AS (
  SELECT h.*, t.sample_size, a.abstract_word_count, a.publication_year, t.has_outcomes, a.pmid IS NOT NULL OR t.nct_id IS NOT NULL AS has_features
  FROM hits h LEFT JOIN article_stats a ON h.doc_id = 'PMID:' || a.pmid LEFT JOIN trial_stats t ON h.doc_id = 'NCT:' || t.nct_id)"""

SEARCH_SQL = "WITH" + ARTICLES_SQL + "," + TRIALS_SQL + "," + ARTICLE_STATS_SQL + "," + TRIAL_STATS_SQL + "," + QUESTIONS_SQL + "," + ROUTED_SQL + "," + INDEX_SQL + PAIRS_SQL + HITS_SQL

SCORE3_SQL = "CAST(CAST(CAST({} AS DECIMAL(18,6)) AS DECIMAL(18,3)) AS VARCHAR)"

ANSWERS_SQL = SEARCH_SQL + f""",
grouped AS (
  SELECT query_id, count(*) AS n, count(*) FILTER (WHERE has_features) AS enriched_n,
    string_agg('[' || doc_id || '] ' || snippet, ' | ' ORDER BY rank) FILTER (WHERE rank <= 3) AS evidence,
    string_agg(concat_ws('; ', CASE WHEN sample_size <> 0 THEN doc_id || ': n=' || sample_size END,
      CASE WHEN abstract_word_count <> 0 THEN doc_id || ': abstract_words=' || abstract_word_count END,
      CASE WHEN publication_year <> 0 THEN doc_id || ': year=' || publication_year END,
      CASE WHEN has_outcomes <> 0 THEN doc_id || ': has_outcomes=True' END), '; ' ORDER BY rank)
      FILTER (WHERE coalesce(sample_size, 0) <> 0 OR coalesce(abstract_word_count, 0) <> 0 OR coalesce(publication_year, 0) <> 0 OR coalesce(has_outcomes, 0) <> 0) AS statistics,
    max({SCORE3_SQL.format('score')}) FILTER (WHERE rank = 1) AS best_score, max(doc_id) FILTER (WHERE rank = 1) AS best_id, max(title) FILTER (WHERE rank = 1) AS best_title,
    count(*) FILTER (WHERE trim(snippet, {BLANKS}) = '') AS blanks,
    string_agg(doc_id, ', ' ORDER BY rank) FILTER (WHERE trim(snippet, {BLANKS}) = '') AS blank_ids
  FROM enriched GROUP BY 1),
answered AS (
  SELECT q.query_id, q.question, q.source_type, coalesce(n, 0) AS retrieved_doc_count, coalesce(enriched_n, 0) AS feature_enriched_count,
    CASE WHEN n IS NULL THEN 'Query: ' || question ELSE 'Analysis of ' || n || ' retrieved biomedical document(s) relevant to: ' || question END AS background,
    CASE WHEN n IS NULL THEN '{ev.NO_DOCUMENTS}' ELSE evidence END AS evidence,
    CASE WHEN n IS NULL THEN '{ev.NO_STATISTICS}' ELSE coalesce(statistics, '{ev.NO_FEATURES}') END AS statistics,
    CASE WHEN n IS NULL THEN '{ev.NO_ANSWER}' ELSE 'Based on ' || n || ' document(s) (top relevance score: ' || best_score ||
      '), the retrieved evidence addresses the query. Primary reference: ' || best_id || ' — ' || best_title || '.' END AS conclusion,
    CASE WHEN n IS NULL THEN '{ev.NO_CITATIONS}' WHEN blanks > 0 THEN blanks || ' citation(s) have empty snippets: ' || blank_ids ELSE '' END AS review_feedback
  FROM routed q LEFT JOIN grouped USING (query_id)),
reviewed AS (SELECT *, CASE WHEN review_feedback = '' THEN 'approved' ELSE 'rejected' END AS review_status FROM answered)
"""


def _routed(spark, sf_dir) -> DataFrame:
    return ev.route_questions(questions(spark, sf_dir))


@dataclass(frozen=True)
class Knowledge:
    """Stored tables a question batch reads."""

    index: DataFrame
    article_features: DataFrame
    trial_features: DataFrame
    clustered: ClusteredVectors
    trials: DataFrame


#: The stored index in cells, by the folder of its application.
_CLUSTERED: dict[str, ClusteredVectors] = {}


def _knowledge(spark, sf_dir) -> Knowledge:
    """Index and features of all articles and trials, read from the snapshot tables their own jobs write.

    The first question batch of an application runs those jobs; later ones find the snapshot published.
    """
    store, run = SnapshotStore(spark, application_folder(spark, "knowledge", sf_dir)), ix.IndexRun("run-1")
    if store.latest_snapshot_id(jobs.index_table(TRIALS)) == UNKNOWN:
        store.write("curated_articles", curated_articles(spark, sf_dir).drop("snapshot_ref"), SNAPSHOT, INGESTED_AT)
        store.write("curated_trials", trials(spark, sf_dir).drop("snapshot_ref"), SNAPSHOT, INGESTED_AT)
        jobs.refresh_features(store, run.run_id, INGESTED_AT)
        for spec in (ARTICLES, TRIALS):
            jobs.refresh_index(store, spec, run, INGESTED_AT)
    index = store.read(jobs.index_table(ARTICLES)).unionByName(store.read(jobs.index_table(TRIALS)))
    if store.root not in _CLUSTERED:
        _CLUSTERED[store.root] = cluster_vectors(index, ev.QUESTION_SEARCH)
    return Knowledge(index, store.read("article_stats"), store.read("trial_stats"), _CLUSTERED[store.root], store.read("curated_trials"))


def _staged(spark, sf_dir, studied: DataFrame) -> DataFrame:
    """Fetched documents ``doc_id, html, payload``: pages of articles, study documents of the stored trials."""
    pages = table(spark, sf_dir, "pages").select(fx.doc_key("PMID", F.col("page_id").cast("string")).alias("doc_id"), "html", F.lit(None).cast("string").alias("payload"))
    summary = F.concat(F.lit("Status "), F.col("status"), F.lit(" for "), F.array_join("conditions", ", "), F.lit(" by "), F.array_join("interventions", ", "))
    module = F.struct(F.struct(F.struct(summary.alias("briefSummary")).alias("descriptionModule")).alias("protocolSection"))
    studies = studied.select(fx.doc_key("NCT", "nct_id").alias("doc_id"), F.lit(None).cast("string").alias("html"), F.to_json(module).alias("payload"))
    return pages.unionByName(studies)


def _retrieved(spark, sf_dir, known: Knowledge) -> ev.Retrieved:
    """Hits of all questions; placeholder content is filled from the fetched page or study document."""
    text = F.coalesce(page_text(F.col("html")), trial_text_from_json(fx.bare_id("doc_id"), F.col("payload")))
    return ev.retrieve(_routed(spark, sf_dir), known.index, staged=_staged(spark, sf_dir, known.trials), staged_text=text, clustered=known.clustered)


def _hits(spark, sf_dir) -> DataFrame:
    known = _knowledge(spark, sf_dir)
    return _retrieved(spark, sf_dir, known).hits


def _enriched(spark, sf_dir) -> DataFrame:
    known = _knowledge(spark, sf_dir)
    return ev.enrich(_retrieved(spark, sf_dir, known), known.article_features, known.trial_features)


def _cited(spark, sf_dir) -> DataFrame:
    return ev.build_citations(ev.collect_docs(_routed(spark, sf_dir), _enriched(spark, sf_dir)))


def _reviewed(spark, sf_dir) -> DataFrame:
    return ev.revision_outcome(ev.review(ev.synthesise_answers(_cited(spark, sf_dir))))


@query("route_questions", "WITH" + QUESTIONS_SQL + "," + ROUTED_SQL + """
SELECT query_id, search_query, search_limit, source_type FROM routed""")
def q_route_questions(spark, sf_dir):
    return _routed(spark, sf_dir).select("query_id", "search_query", "search_limit", "source_type")


@query("batch_questions", "WITH" + """
questions AS (SELECT conv_id * 1000000 + turn AS query_id, text AS question, NULL::VARCHAR AS given_type, NULL::DATE AS date_from, NULL::DATE AS date_to
  FROM conversations WHERE role = 'user'),""" + ROUTED_SQL + " SELECT query_id, search_query, source_type FROM routed")
def q_batch_questions(spark, sf_dir):
    """User turns of conversations as one batch of questions."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    asked = turns.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return ev.route_questions(asked).select("query_id", "search_query", "source_type")


@query("search_filters", SEARCH_SQL + " SELECT query_id, rank, doc_id, score, title, source_type, md5(snippet) AS snippet_md5, md5(content) AS content_md5 FROM hits")
def q_search_filters(spark, sf_dir):
    return _hits(spark, sf_dir).select(
        "query_id", "rank", "doc_id", "score", "title", "source_type", F.md5("snippet").alias("snippet_md5"), F.md5("content").alias("content_md5")
    )


@query("search_limits", "WITH" + ARTICLES_SQL + "," + TRIALS_SQL + "," + QUESTIONS_SQL + "," + ROUTED_SQL + "," + INDEX_SQL + PAIRS_SQL + """,
own AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 10 WHEN 2 THEN 1 ELSE 5 END AS own_limit,
  CASE item_id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'trial' END AS one_type FROM benchmark),
ranked AS (SELECT p.query_id, p.doc_id, p.score, own_limit, row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, p.doc_id) AS r
  FROM pairs p JOIN docs d USING (doc_id) JOIN own o ON o.query_id = p.query_id WHERE one_type IS NULL OR one_type = d.source_type)
SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= own_limit""")
def q_search_limits(spark, sf_dir):
    """Questions with their own number of hits, some of them for one collection only."""
    no = F.col("query_id")
    limit = F.when(no % 4 == 0, 3).when(no % 4 == 1, 10).when(no % 4 == 2, 1)
    one = F.when(no % 5 == 0, F.array(F.lit(ARTICLES.collection))).when(no % 5 == 1, F.array(F.lit(TRIALS.collection)))
    asked = ev.route_questions(questions(spark, sf_dir).withColumns({"search_limit": limit, "collections": one}))
    known = _knowledge(spark, sf_dir)
    return ev.retrieve(asked, known.index, clustered=known.clustered).keys.select("query_id", "doc_id", "score", "rank")


@query("enrich_docs", SEARCH_SQL + """
SELECT query_id, rank, doc_id, sample_size, abstract_word_count, publication_year, has_outcomes FROM enriched""")
def q_enrich_docs(spark, sf_dir):
    return _enriched(spark, sf_dir).select("query_id", "rank", "doc_id", *[F.col("features")[n].alias(n) for n in ev.NUMBERS])


@query("citations", SEARCH_SQL + """
SELECT query_id, rank - 1 AS position, doc_id AS id, source_type AS type, snippet, score, title, md5(content) AS content_md5, snapshot_ref FROM hits""")
def q_citations(spark, sf_dir):
    return ev.citation_rows(_cited(spark, sf_dir)).withColumn("content_md5", F.md5("content")).drop("content")


@query("answers", ANSWERS_SQL + "SELECT query_id, background, evidence, statistics, conclusion, retrieved_doc_count, feature_enriched_count FROM reviewed")
def q_answers(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("query_id", "answer.*", "retrieved_doc_count", "feature_enriched_count")


@query("reviews", ANSWERS_SQL + """
SELECT query_id, review_status, review_feedback, CASE WHEN review_status = 'approved' THEN 1 ELSE 2 END AS revision_count,
  CASE WHEN review_status = 'approved' THEN 6 ELSE 8 END AS step_count FROM reviewed""")
def q_reviews(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("query_id", "review_status", "review_feedback", "revision_count", F.size("steps").alias("step_count"))


@query("refusals", ANSWERS_SQL + f"""
SELECT query_id, question, 'DQ-UI-1' AS refusal_rule, '{ev.NO_CITATIONS}' AS refusal_reason, coalesce(source_type, 'article,trial') AS missing_evidence
FROM reviewed WHERE retrieved_doc_count = 0""")
def q_refusals(spark, sf_dir):
    return ev.refusals(_reviewed(spark, sf_dir)).withColumn("missing_evidence", F.array_join("missing_evidence", ","))


@query("answer_sections", ANSWERS_SQL + """
SELECT query_id, 0 AS position, 'Background' AS label, background AS section_text FROM reviewed UNION ALL
SELECT query_id, 1, 'Evidence', evidence FROM reviewed UNION ALL SELECT query_id, 2, 'Statistics', statistics FROM reviewed UNION ALL
SELECT query_id, 3, 'Conclusion', conclusion FROM reviewed""")
def q_answer_sections(spark, sf_dir):
    return ev.answer_sections(_reviewed(spark, sf_dir))


@query("claim_map", SEARCH_SQL + """
SELECT query_id, claim_ref, doc_id, snippet, snapshot_ref FROM enriched JOIN (VALUES ('background'), ('evidence'), ('statistics'), ('conclusion')) c(claim_ref)
ON claim_ref = 'background' OR (claim_ref = 'evidence' AND rank <= 3) OR (claim_ref = 'statistics' AND has_features) OR (claim_ref = 'conclusion' AND rank = 1)""")
def q_claim_map(spark, sf_dir):
    return ev.claim_map(_reviewed(spark, sf_dir))


@query("evidence_items", SEARCH_SQL + """
SELECT query_id, 'document' AS kind, doc_id, 'snippet' AS name, sha256(snippet) AS value, NULL::TIMESTAMP AS value_time, NULL AS view_version, snapshot_ref FROM enriched
UNION ALL SELECT query_id, 'statistic', doc_id, name, CAST(number AS VARCHAR), TIMESTAMP '2024-05-01 12:00:00', 'v1', snapshot_ref
FROM (SELECT query_id, doc_id, snapshot_ref, unnest(['sample_size', 'abstract_word_count', 'publication_year', 'has_outcomes']) AS name,
  unnest([sample_size, abstract_word_count, publication_year, has_outcomes]) AS number FROM enriched) WHERE number IS NOT NULL""")
def q_evidence_items(spark, sf_dir):
    return ev.evidence_items(_reviewed(spark, sf_dir), "v1", F.lit("2024-05-01 12:00:00").cast("timestamp_ntz"))


def _manifests(spark, sf_dir) -> DataFrame:
    """Manifests of all answers; those of rejected ones are two days old."""
    created = F.when(F.col("review_status") == "approved", F.lit("2024-05-01 12:00:00")).otherwise(F.lit("2024-04-29 12:00:00"))
    step = F.transform("steps", lambda s, i: F.struct(s.alias("step"), F.lit(None).cast("string").alias("started_at"), (i * 10).cast("long").alias("elapsed_ms")))
    reviewed = _reviewed(spark, sf_dir).withColumn("execution_timeline", step)
    return ev.build_manifests(reviewed, created.cast("timestamp_ntz"))


_UUID_SQL = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    substr('89ab', CAST((CAST('0x' || substr(h, 17, 1) AS BIGINT) & 3) + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""

MANIFESTS_SQL = ANSWERS_SQL + f""",
manifests AS (SELECT *, {_UUID_SQL} AS manifest_id, CASE WHEN review_status = 'approved' THEN TIMESTAMP '2024-05-01 12:00:00' ELSE TIMESTAMP '2024-04-29 12:00:00' END AS created_at
  FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('manifest:' || query_id)) AS h FROM reviewed WHERE retrieved_doc_count > 0))
"""


@query("manifests", MANIFESTS_SQL + """
SELECT manifest_id, query_id, question, source_type, md5(background || evidence || statistics || conclusion) AS answer_md5, review_status, review_feedback,
  retrieved_doc_count, feature_enriched_count, CAST(retrieved_doc_count AS INTEGER) AS citation_count,
  CASE WHEN review_status = 'approved' THEN 6 ELSE 8 END AS steps, created_at FROM manifests""")
def q_manifests(spark, sf_dir):
    answer = F.md5(F.concat("answer.background", "answer.evidence", "answer.statistics", "answer.conclusion"))
    return _manifests(spark, sf_dir).select(
        "manifest_id", "query_id", "question", F.col("filters.source_type").alias("source_type"), answer.alias("answer_md5"), "review_status",
        "review_feedback", "retrieved_doc_count", "feature_enriched_count", F.size("citations").alias("citation_count"),
        F.size("execution_timeline").alias("steps"), "created_at",
    )


@query("audit_lookup", MANIFESTS_SQL + f"""
SELECT i.manifest_id, m.query_id, m.review_status, m.query_id IS NOT NULL AS found
FROM (SELECT {_UUID_SQL} AS manifest_id FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('manifest:' || item_id)) AS h FROM benchmark)) i
LEFT JOIN (SELECT * FROM manifests WHERE created_at > TIMESTAMP '2024-05-01 18:00:00' - INTERVAL 24 HOURS) m USING (manifest_id)""")
def q_audit_lookup(spark, sf_dir):
    """Look up every question's manifest six hours later: refused ones have none, rejected ones have expired."""
    ids = table(spark, sf_dir, "benchmark").select(fx.uuid5(F.concat(F.lit("manifest:"), F.col("item_id").cast("string"))).alias("manifest_id"))
    looked = ev.audit_lookup(ids, _manifests(spark, sf_dir), F.lit("2024-05-01 18:00:00").cast("timestamp_ntz"))
    return looked.select("manifest_id", "query_id", "review_status", "found")


@query("timeline_table", MANIFESTS_SQL + """
SELECT manifest_id, CAST(position AS INTEGER) AS position, label AS node, CAST(position * 10 AS BIGINT) AS elapsed_ms, '' AS started_at FROM (
  SELECT manifest_id, unnest(labels) AS label, generate_subscripts(labels, 1) - 1 AS position FROM (SELECT manifest_id,
    CASE WHEN review_status = 'approved' THEN ['CMO Router', 'Medical Librarian', 'Clinical Biostatistician', 'Lead Researcher', 'Peer Reviewer', 'Finalize']
    ELSE ['CMO Router', 'Medical Librarian', 'Clinical Biostatistician', 'Lead Researcher', 'Peer Reviewer', 'Lead Researcher', 'Peer Reviewer', 'Finalize'] END AS labels FROM manifests))""")
def q_timeline_table(spark, sf_dir):
    return rp.timeline_table(_manifests(spark, sf_dir))


@query("replay_diff", SEARCH_SQL + """,
later AS (SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM pairs WHERE journal IS NULL OR journal NOT IN ('src1', 'src2', 'src4')) WHERE r <= 5)
SELECT query_id, doc_id, t.score AS stored_score, l.score AS replayed_score,
  CASE WHEN t.rank IS NULL THEN 'added' WHEN l.rank IS NULL THEN 'removed' ELSE 'changed' END AS difference
FROM top t FULL JOIN later l USING (query_id, doc_id) WHERE t.rank IS DISTINCT FROM l.rank OR t.score IS DISTINCT FROM l.score""")
def q_replay_diff(spark, sf_dir):
    """Hits of the recorded snapshot against a later one that lost three journals."""
    columns = ["query_id", "doc_id", "score", "rank"]
    known = _knowledge(spark, sf_dir)
    lost = curated_articles(spark, sf_dir).filter("journal IN ('src1', 'src2', 'src4')").select(fx.doc_key("PMID", "pmid").alias("doc_id"))
    lost = written(lost, "lost")
    later, cells = known.index.join(lost, "doc_id", "left_anti"), known.clustered.without(lost)
    stored = ev.retrieve(_routed(spark, sf_dir), known.index, clustered=known.clustered).hits.select(*columns)
    return ev.replay_diff(stored, ev.retrieve(_routed(spark, sf_dir), later, clustered=cells).hits.select(*columns))


@query("rank_sources", SEARCH_SQL + " SELECT query_id, rank - 1 AS position, doc_id AS id, rank AS source_no FROM hits")
def q_rank_sources(spark, sf_dir):
    return rp.rank_sources(ev.citation_rows(_cited(spark, sf_dir))).select("query_id", "position", "id", "source_no")


@query("documents_by_score", SEARCH_SQL + """
SELECT query_id, rank AS source_no, coalesce(nullif(title, ''), doc_id) AS title, source_type AS type, doc_id AS id, score, snippet,
  md5(coalesce(content, '')) AS content_md5, snapshot_ref FROM hits""")
def q_documents_by_score(spark, sf_dir):
    return rp.documents_by_score(ev.citation_rows(_cited(spark, sf_dir))).withColumn("content_md5", F.md5("content")).drop("content")


@query("source_digest", SEARCH_SQL + f"""
SELECT query_id, CASE WHEN n = 0 THEN '{rp.DIGEST_NONE}' WHEN digest IS NULL THEN '{rp.DIGEST_EMPTY}'
  ELSE '### 📄 Summary of Retrieved Documentation Content' || chr(10) || chr(10) || digest END AS digest
FROM (SELECT q.query_id, count(h.doc_id) AS n,
  string_agg('**[' || rank || '] ' || title || ' (' || doc_id || ')**' || chr(10) || '> ' || trim(snippet, {BLANKS}) || chr(10), chr(10) ORDER BY rank)
    FILTER (WHERE trim(snippet, {BLANKS}) <> '') AS digest
  FROM routed q LEFT JOIN hits h USING (query_id) GROUP BY 1)""")
def q_source_digest(spark, sf_dir):
    return rp.source_digest(_cited(spark, sf_dir))


@query("citation_text", SEARCH_SQL + f"""
SELECT query_id, rank - 1 AS position, '[' || source_type || '] ' || doc_id AS badge,
  '**[' || source_type || '] ' || doc_id || '** (score: ' || {SCORE3_SQL.format('score')} || ')' || chr(10) || '*' || title || '*' ||
  CASE WHEN snippet <> '' THEN chr(10) || '> ' || snippet ELSE '' END ||
  CASE WHEN content <> '' THEN chr(10) || chr(10) || '**Full Content:**' || chr(10) || content ELSE '' END ||
  chr(10) || chr(10) || 'snapshot: `' || snapshot_ref || '`' AS detail FROM hits""")
def q_citation_text(spark, sf_dir):
    return ev.citation_text(_cited(spark, sf_dir))


@query("resolve_citations", SEARCH_SQL + """
SELECT query_id, doc_id AS id, snapshot_ref FROM hits WHERE doc_id NOT IN (
  SELECT 'PMID:' || doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'NCT:' || nct_id FROM trials WHERE status <> 'O')""")
def q_resolve_citations(spark, sf_dir):
    """Citations against a snapshot that keeps English articles and trials that are not open."""
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select(fx.doc_key("PMID", F.col("doc_id").cast("string")).alias("doc_id"))
    closed = trials(spark, sf_dir).filter("status <> 'O'").select(fx.doc_key("NCT", "nct_id").alias("doc_id"))
    keys = english.unionByName(closed).withColumn("snapshot_ref", F.lit(SNAPSHOT))
    return ev.unresolved_citations(ev.citation_rows(_cited(spark, sf_dir)), keys).select("query_id", "id", "snapshot_ref")


@query("dq_contracts_answers", ANSWERS_SQL + f"""
SELECT 'DQ-UI-1' AS rule_id, 'FAIL' AS severity, CAST(query_id AS VARCHAR) AS record_id, 'Answer has no citation' AS message FROM reviewed WHERE retrieved_doc_count = 0
UNION ALL SELECT 'DQ-UI-4', 'FAIL', CAST(query_id AS VARCHAR), 'Refusal has no reason' FROM reviewed WHERE retrieved_doc_count = 0 AND length(question) < 115
UNION ALL SELECT 'DQ-UI-5', 'WARN', CAST(query_id AS VARCHAR), 'Manifest cannot be retrieved; answer is degraded' FROM reviewed WHERE review_status = 'rejected'
UNION ALL SELECT 'DQ-UI-2', 'FAIL', query_id || '#' || (rank - 1), 'Bad citation fields: [''snippet'']' FROM hits WHERE trim(snippet, {BLANKS}) = ''""")
def q_dq_contracts_answers(spark, sf_dir):
    """Answer and citation contracts; the shortest refused questions have no reason, rejected ones no manifest."""
    reason = F.when((F.size("citations") == 0) & (F.length("question") >= 115), F.lit(ev.NO_CITATIONS))
    reviewed = _reviewed(spark, sf_dir)
    answers = reviewed.withColumns({"refusal_reason": reason, "manifest_found": F.col("review_status") == "approved"})
    citations = ev.citation_rows(reviewed)
    citation_id = F.concat_ws("#", F.col("query_id").cast("string"), F.col("position").cast("string"))
    return dq.row_violations(answers, dq.answer_rules(), F.col("query_id")).unionByName(
        dq.row_violations(citations, dq.citation_rules(), citation_id)
    )


@query("dq_contracts_index", "WITH" + ARTICLES_SQL + """
SELECT 'DQ-VEC-1' AS rule_id, 'FAIL' AS severity, 'PMID:' || pmid AS record_id, 'Missing vector fields: [''snippet'']' AS message FROM articles
  WHERE trim(substr(coalesce(abstract, ''), 1, 500), """ + BLANKS + """) = ''
UNION ALL SELECT 'COLLECTION-DIM', 'FAIL', 'PMID:' || pmid, 'expected 64 dimensions, got 32' FROM articles WHERE journal = 'src2'
UNION ALL SELECT 'DQ-FEAST-1', 'FAIL', pmid, 'Missing feature lineage fields: [''snapshot_ref'']' FROM articles WHERE publication_date IS NULL
UNION ALL SELECT 'DQ-P2', 'FAIL', pmid, 'Missing lineage fields: [''job_version'']' FROM articles WHERE journal = 'src4'
UNION ALL SELECT 'DQ-X-2', 'FAIL', pmid, 'Missing snippet fields: [''section_text'']' FROM articles WHERE trim(coalesce(abstract, ''), """ + BLANKS + """) = ''
UNION ALL SELECT 'DQ-X-1', 'WARN', pmid, 'Missing mention fields: [''section_no'']' FROM articles WHERE abstract IS NULL""")
def q_dq_contracts_index(spark, sf_dir):
    """Contracts of index, feature, curated, snippet and mention rows, with fields left out where the source has none."""
    articles = curated_articles(spark, sf_dir)
    half = F.when(F.col("title").isNotNull() & F.col("short"), F.slice("vector", 1, 32)).otherwise(F.col("vector"))
    short = articles.select(fx.doc_key("PMID", "pmid").alias("doc_id"), (F.col("journal") == "src2").alias("short"))
    index = ix.index_articles(articles, SNAPSHOT, ix.IndexRun("run-1")).join(short, "doc_id").withColumn("vector", half)
    ref = F.when(F.col("publication_date").isNotNull(), F.col("snapshot_ref"))
    features = ft.stamp_features(articles.withColumn("snapshot_ref", ref), F.lit(None).cast("timestamp"), "run-1", "v1")
    lineage = articles.withColumn("job_version", F.when(F.col("journal") != "src4", F.lit("1")))
    snippets = articles.select("pmid", F.col("pmid").alias("doc_id"), F.lit("abstract").alias("section_type"), F.col("abstract").alias("section_text"), "snapshot_ref")
    mentions = articles.select("pmid", F.col("pmid").alias("doc_id"), F.when(F.col("abstract").isNotNull(), F.lit(1)).alias("section_no"))
    return (
        dq.row_violations(index, dq.vector_rules(64), F.col("doc_id"))
        .unionByName(dq.row_violations(features, dq.feature_rules(), F.col("pmid")))
        .unionByName(dq.row_violations(lineage, dq.lineage_rules(), F.col("pmid")))
        .unionByName(dq.row_violations(snippets, dq.snippet_rules(), F.col("pmid")))
        .unionByName(dq.row_violations(mentions, dq.mention_rules(), F.col("pmid")))
    )


LINES_SQL = """
lines AS (SELECT event_id, ts, user_id, event_type,
  CASE event_type WHEN 'view' THEN 'cmo_router' WHEN 'click' THEN 'peer_reviewer' ELSE 'custom_step' END AS node, event_type IN ('view', 'click', 'purchase') AS ok FROM events)"""


def event_lines(spark, sf_dir) -> DataFrame:
    """Events as step event lines: errors are broken JSON, signups no data lines; purchases come without a summary."""
    node = F.when(F.col("event_type") == "view", "cmo_router").when(F.col("event_type") == "click", "peer_reviewer").otherwise("custom_step")
    summary = F.when(F.col("event_type") != "purchase", F.lit("done"))
    body = F.to_json(F.struct(
        node.alias("node"), F.col("event_id").alias("elapsed_ms"), F.col("user_id").cast("string").alias("query_id"), F.lit("completed").alias("status"),
        summary.alias("summary"), F.lit("agent").alias("agent"),
    ))
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("data: {bad "), body)).when(F.col("event_type") == "signup", F.concat(F.lit("event: "), body))
        .otherwise(F.concat(F.lit("data: "), body))
    )
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", line.alias("line"))


@query("event_lines", "WITH" + LINES_SQL + """
SELECT event_id, node, event_id AS elapsed_ms, CAST(user_id AS VARCHAR) AS query_id, 'completed' AS status,
  CASE WHEN event_type <> 'purchase' THEN 'done' END AS summary, 'agent' AS agent,
  CASE node WHEN 'cmo_router' THEN 'CMO Router' WHEN 'peer_reviewer' THEN 'Peer Reviewer' ELSE node END AS label FROM lines WHERE ok""")
def q_event_lines(spark, sf_dir):
    return rp.event_rows(event_lines(spark, sf_dir), parse_event_line(F.col("line")), ["event_id"])


@query("dq_event_lines", """
SELECT 'DQ-UI-3' AS rule_id, 'FAIL' AS severity, CAST(event_id AS VARCHAR) AS record_id, 'Event is malformed' AS message
FROM events WHERE event_type IN ('error', 'signup', 'purchase')""")
def q_dq_event_lines(spark, sf_dir):
    return dq.row_violations(event_lines(spark, sf_dir), dq.event_rules(), F.col("event_id"))
