"""Registered queries: features, entities, text vectors, index and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.functions.vectors import cosine, embed, l2_norm, l2_normalise
from larkspur.operators import entities as en
from larkspur.operators import features as ft
from larkspur.operators import index as ix
from larkspur.operators.quantiles import exact_quantiles
from larkspur.operators.search import SearchColumns, cluster_vectors, merge_topk, scored_shares, vector_topk
from larkspur.plans.data import ARTICLES_SQL, SNAPSHOT, TRIALS_SQL, curated_articles, table, trials
from larkspur.plans.register import new_register
from larkspur.sources.snapshots import latest_snapshots
from larkspur.sources.specs import ARTICLES, TRIALS

QUERIES, ORACLES, query = new_register()


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words_sql(c: str) -> str:
    return f"""CASE WHEN trim(coalesce({c}, ''), {BLANKS}) = '' THEN 0
      ELSE len(string_split_regex(trim({c}, {BLANKS}), '\\s+')) END"""


ARTICLE_STATS_SQL = f"""
article_stats AS (
  SELECT pmid, CAST({_words_sql('title')} AS BIGINT) AS title_word_count, CAST({_words_sql('abstract')} AS BIGINT) AS abstract_word_count,
    CAST(coalesce(TRY_CAST(regexp_extract(publication_date, '^([0-9]{{4}})(-|$)', 1) AS BIGINT), 0) AS BIGINT) AS publication_year,
    CAST(trim(coalesce(abstract, ''), {BLANKS}) <> '' AS BIGINT) AS has_abstract, journal AS journal_encoded, snapshot_ref
  FROM articles)"""

TRIAL_STATS_SQL = """
trial_stats AS (
  SELECT nct_id, CAST(coalesce(sample_size, 0) AS BIGINT) AS sample_size,
    CAST(coalesce(len(primary_outcomes), 0) > 0 AS BIGINT) AS has_outcomes, status AS status_encoded,
    CAST(coalesce(len(conditions), 0) AS BIGINT) AS condition_count, snapshot_ref FROM trials)"""


@query("article_stats", "WITH" + ARTICLES_SQL + "," + ARTICLE_STATS_SQL + " SELECT * FROM article_stats")
def q_article_stats(spark, sf_dir):
    return ft.article_stats(curated_articles(spark, sf_dir))


@query("trial_stats", "WITH" + TRIALS_SQL + "," + TRIAL_STATS_SQL + " SELECT * FROM trial_stats")
def q_trial_stats(spark, sf_dir):
    return ft.trial_stats(trials(spark, sf_dir))


@query("feature_refresh", "WITH" + ARTICLES_SQL + "," + ARTICLE_STATS_SQL + """
SELECT pmid, abstract_word_count, publication_year, CASE WHEN publication_year > 2019 THEN 's2' ELSE 's1' END AS snapshot_ref,
  CASE WHEN publication_year > 2019 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS event_timestamp
FROM article_stats WHERE publication_year > 0""")
def q_feature_refresh(spark, sf_dir):
    """Three refreshes: a very old one of everything, one of all dated articles, a later one of the recent articles."""
    stats = ft.article_stats(curated_articles(spark, sf_dir))

    def refresh(rows: DataFrame, ref: str, day: str) -> DataFrame:
        at = F.lit(day).cast("timestamp_ntz")
        return ft.stamp_features(rows.withColumn("snapshot_ref", F.lit(ref)), at, f"run-{ref}", "v1")

    history = (
        refresh(stats, "s0", "2021-01-01")
        .unionByName(refresh(stats.filter("publication_year > 0"), "s1", "2024-01-01"))
        .unionByName(refresh(stats.filter("publication_year > 2019"), "s2", "2024-02-01"))
        .unionByName(refresh(stats, "s3", "2024-06-01"))
    )
    newest = ft.materialise_features(history, "pmid", F.lit("2024-03-01").cast("timestamp_ntz"))
    return newest.select("pmid", "abstract_word_count", "publication_year", "snapshot_ref", "event_timestamp")


@query("feature_lookup_batch", "WITH" + ARTICLES_SQL + "," + ARTICLE_STATS_SQL + """,
keys AS (SELECT doc_id AS position, CAST(doc_id AS VARCHAR) AS pmid FROM labels
  UNION ALL SELECT doc_id + 1000000000, CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1
  UNION ALL SELECT -doc_id - 1, 'x' || doc_id FROM labels)
SELECT position, pmid, title_word_count, abstract_word_count, publication_year FROM keys JOIN article_stats USING (pmid)""")
def q_feature_lookup_batch(spark, sf_dir):
    """Keys of the labelled documents, the good ones asked twice, plus keys nobody has."""
    labels = table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string").alias("pmid")
    keys = (
        labels.select(F.col("doc_id").alias("position"), key)
        .unionByName(labels.filter("quality = 1").select((F.col("doc_id") + 1000000000).alias("position"), key))
        .unionByName(labels.select((-F.col("doc_id") - 1).alias("position"), F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("pmid")))
    )
    features = ft.article_stats(curated_articles(spark, sf_dir)).select("pmid", "title_word_count", "abstract_word_count", "publication_year")
    return ft.feature_lookup(keys, features, "pmid", "title_word_count")


@query("features_as_of", """
SELECT c.event_id, c.user_id, c.ts, CASE WHEN p.ts > c.ts - INTERVAL 2 DAYS THEN p.ts END AS valid_from,
  CASE WHEN p.ts > c.ts - INTERVAL 2 DAYS THEN p.value END AS value
FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def q_features_as_of(spark, sf_dir):
    """The last purchase value of the user at each click, valid for two days."""
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("event_timestamp"), "value", "event_id")
    return ft.features_as_of(clicks, purchases, "user_id", "ts", ["value"], ttl_days=2, tie_break="event_id")


@query("feature_staleness", """
WITH f AS (SELECT event_type AS table_name, strftime(ts, '%Y-%m-%d') AS snapshot_ref, max(ts) AS refreshed_at, count(*) AS feature_rows
  FROM events GROUP BY 1, 2),
c AS (SELECT event_type AS table_name, max(strftime(ts, '%Y-%m-%d')) AS snapshot_id FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT table_name, snapshot_ref, refreshed_at, feature_rows, snapshot_id, snapshot_ref <> coalesce(snapshot_id, 'unknown') AS snapshot_outdated,
  refreshed_at < TIMESTAMP '2024-01-30 12:00:00' AS too_old,
  snapshot_ref <> coalesce(snapshot_id, 'unknown') OR refreshed_at < TIMESTAMP '2024-01-30 12:00:00' AS stale
FROM f LEFT JOIN c USING (table_name)""")
def q_feature_staleness(spark, sf_dir):
    """Days of events as snapshots of one table per event type; one table has no current snapshot."""
    events = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    log = events.filter("event_type <> 'view'").select(
        F.col("event_type").alias("table_name"), day.alias("snapshot_id"), F.col("ts").alias("committed_at"), F.col("event_id").alias("seq")
    )
    features = events.select(F.col("event_type").alias("table_name"), day.alias("snapshot_ref"), F.col("ts").alias("event_timestamp"))
    return ft.feature_staleness(features, latest_snapshots(log), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))


_OUTCOMES_SQL = """
WITH o AS (SELECT p_type, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS price, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def _outcomes(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_returnflag")
    price = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))
    return lines.join(parts, "l_partkey").select("p_type", price.alias("price"), "l_returnflag")


@query("outcome_distribution", _OUTCOMES_SQL + """
SELECT p_type, count(*) AS outcomes, count(price) AS known, round(avg(price), 4) AS mean_value, round(stddev_samp(price), 4) AS sd_value,
  round(count(*) FILTER (WHERE l_returnflag = 'A') / count(*), 6) AS success_rate FROM o GROUP BY 1""")
def q_outcome_distribution(spark, sf_dir):
    out = ft.outcome_summary(_outcomes(spark, sf_dir), ["p_type"], "price", F.col("l_returnflag") == "A")
    return out.withColumns({c: F.round(c, 4) for c in ("mean_value", "sd_value")}).withColumn("success_rate", F.round("success_rate", 6))


@query("outcome_quantiles", _OUTCOMES_SQL + """
SELECT p_type, p AS probability, round(quantile_cont(price, p), 4) AS quantile FROM (
  SELECT p_type, price, unnest([0.05, 0.25, 0.5, 0.95]::DOUBLE[]) AS p FROM o) GROUP BY 1, 2
""".replace("quantile_cont(price, p)", """CASE p WHEN 0.05 THEN quantile_cont(price, 0.05) WHEN 0.25 THEN quantile_cont(price, 0.25)
  WHEN 0.5 THEN quantile_cont(price, 0.5) ELSE quantile_cont(price, 0.95) END"""))
def q_outcome_quantiles(spark, sf_dir):
    out = exact_quantiles(_outcomes(spark, sf_dir), ["p_type"], "price", [0.05, 0.25, 0.5, 0.95])
    return out.withColumn("quantile", F.round("quantile", 4))


@query("feature_registry", """
SELECT view, count(*) AS fields, CAST(sum(CASE WHEN units IS NULL AND data_type = 'bigint' THEN 1 ELSE 0 END) AS BIGINT) AS without_units FROM (VALUES
  ('article_stats', 'bigint', 'words'), ('article_stats', 'bigint', 'words'), ('article_stats', 'bigint', 'year'), ('article_stats', 'bigint', 'flag'),
  ('article_stats', 'string', NULL), ('article_stats', 'string', NULL), ('trial_stats', 'bigint', 'n'), ('trial_stats', 'bigint', 'flag'),
  ('trial_stats', 'string', NULL), ('trial_stats', 'bigint', 'n'), ('trial_stats', 'string', NULL)) v(view, data_type, units)
WHERE EXISTS (SELECT 1 FROM documents) GROUP BY 1""")
def q_feature_registry(spark, sf_dir):
    """Registered fields that hold a value anywhere in the feature tables."""

    def filled(view: str, df: DataFrame) -> DataFrame:
        counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
        fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("values")) for c in df.columns])
        return counted.select(F.lit(view).alias("view"), F.inline(fields)).filter(F.col("values") > 0)

    found = filled("article_stats", ft.article_stats(curated_articles(spark, sf_dir))).unionByName(
        filled("trial_stats", ft.trial_stats(trials(spark, sf_dir)))
    )
    return ft.feature_registry(spark).join(found, ["view", "field"], "left_semi").groupBy("view").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("units").isNull() & (F.col("data_type") == "bigint")).alias("without_units")
    )


SECTIONS_SQL = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS section_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_no FROM documents),
placed AS (SELECT *, coalesce(sum(length(section_text) + 1) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section_start FROM lines),
sections AS (SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, section_text, CAST(section_start AS INTEGER) AS section_start FROM placed
  WHERE trim(section_text, """ + BLANKS + """) <> '')"""

MENTIONS_SQL = "WITH RECURSIVE" + TRIALS_SQL + f""",
texts AS (
  SELECT 'PMID:' || doc_id AS doc_id, 'article' AS source_type, text FROM documents
  UNION ALL SELECT 'NCT:' || nct_id, 'trial', concat_ws(chr(10), brief_title, array_to_string(conditions, ', '), array_to_string(interventions, ', ')) FROM trials),
lines AS (SELECT doc_id, source_type, unnest(string_split(text, chr(10))) AS section_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_no FROM texts),
placed AS (SELECT *, coalesce(sum(length(section_text) + 1) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section_start FROM lines),
parts AS (SELECT doc_id, source_type, section_no, section_start, unnest(string_split_regex(section_text, '\\s')) AS word,
    generate_subscripts(string_split_regex(section_text, '\\s'), 1) - 1 AS word_no FROM placed WHERE trim(section_text, {BLANKS}) <> ''),
offsets AS (SELECT *, trim(lower(word), '.,;:?!()') AS w, section_start + coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, section_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mention_start FROM parts),
numbered AS (SELECT *, row_number() OVER v AS pos, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3, lead(w, 3) OVER v AS w4, lead(w, 4) OVER v AS w5
  FROM offsets WHERE w <> '' WINDOW v AS (PARTITION BY doc_id, section_no ORDER BY word_no)),
bench AS (SELECT item_id, list_filter([trim(lower(x), '.,;:?!()') FOR x IN string_split_regex(text, '\\s')], lambda x: x <> '') AS ws FROM benchmark),
terms AS (
  SELECT DISTINCT term FROM (
    SELECT unnest(ws) AS term FROM bench UNION ALL SELECT array_to_string(ws[1:2 + item_id % 4], ' ') FROM bench UNION ALL SELECT array_to_string(ws[4:5 + item_id % 3], ' ') FROM bench
    UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT lower(p_name) FROM part)
  WHERE term NOT IN ({', '.join(f"'{w}'" for w in fx.STOP_WORDS)}) AND term <> ''),
grams AS (
  SELECT doc_id, section_no, pos, 1 AS n, w AS term FROM numbered UNION ALL SELECT doc_id, section_no, pos, 2, w || ' ' || w2 FROM numbered UNION ALL SELECT doc_id, section_no, pos, 3, w || ' ' || w2 || ' ' || w3 FROM numbered
  UNION ALL SELECT doc_id, section_no, pos, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM numbered UNION ALL SELECT doc_id, section_no, pos, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM numbered),
longest AS (SELECT doc_id, section_no, pos, max(n) AS n, arg_max(term, n) AS term FROM grams JOIN terms USING (term) GROUP BY 1, 2, 3),
chained AS (
  SELECT l.*, nx.pos AS next_pos FROM (SELECT *, pos + n AS free FROM longest) l
  ASOF LEFT JOIN longest nx ON l.doc_id = nx.doc_id AND l.section_no = nx.section_no AND l.free <= nx.pos),
picked AS (
  SELECT c.doc_id, c.section_no, c.pos, c.next_pos FROM chained c JOIN (SELECT doc_id, section_no, min(pos) AS pos FROM longest GROUP BY 1, 2) f USING (doc_id, section_no, pos)
  UNION ALL SELECT c.doc_id, c.section_no, c.pos, c.next_pos FROM picked p JOIN chained c ON c.doc_id = p.doc_id AND c.section_no = p.section_no AND c.pos = p.next_pos),
mentions AS (
  SELECT doc_id, m.source_type, CAST(section_no AS INTEGER) AS section_no, l.term, CAST(word_no AS INTEGER) AS word_no, CAST(mention_start AS INTEGER) AS mention_start
  FROM picked JOIN longest l USING (doc_id, section_no, pos) JOIN numbered m USING (doc_id, section_no, pos))
"""


def _sections(spark, sf_dir) -> DataFrame:
    return en.sections(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _terms(spark, sf_dir) -> DataFrame:
    """Dictionary: the words of the benchmark texts and two phrases of each, types and names of parts; no stop words."""
    split = F.transform(F.split("text", fx.WHITESPACE), lambda w: F.btrim(F.lower(w), F.lit(fx.PUNCTUATION)))
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.filter(split, lambda w: w != "").alias("ws"))
    first, inner = F.slice("ws", F.lit(1), (F.col("item_id") % 4 + 2).cast("int")), F.slice("ws", F.lit(4), (F.col("item_id") % 3 + 2).cast("int"))
    phrases = bench.select(F.explode(F.concat("ws", F.array(F.array_join(first, " "), F.array_join(inner, " ")))).alias("term"))
    parts = table(spark, sf_dir, "part").select(F.explode(F.array(F.lower("p_type"), F.lower("p_name"))).alias("term"))
    return phrases.unionByName(parts).filter((F.col("term") != "") & ~F.col("term").isin(*fx.STOP_WORDS)).distinct()


def _mentions(spark, sf_dir) -> DataFrame:
    """Mentions in the sections of all articles and trials."""
    articles = table(spark, sf_dir, "documents").select(fx.doc_key("PMID", F.col("doc_id").cast("string")).alias("doc_id"), F.lit("article").alias("source_type"), "text")
    text = F.concat_ws("\n", "brief_title", F.array_join("conditions", ", "), F.array_join("interventions", ", "))
    studies = trials(spark, sf_dir).select(fx.doc_key("NCT", "nct_id").alias("doc_id"), F.lit("trial").alias("source_type"), text.alias("text"))
    return en.entity_mentions(en.sections(articles.unionByName(studies)), _terms(spark, sf_dir), keep=("doc_id", "source_type"))


@query("sections", "WITH" + SECTIONS_SQL + " SELECT doc_id, section_no, md5(section_text) AS section_md5, section_start FROM sections")
def q_sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section_no", F.md5("section_text").alias("section_md5"), "section_start")


@query("trial_outcomes", "WITH" + TRIALS_SQL + """
SELECT nct_id, CAST(generate_subscripts(primary_outcomes, 1) - 1 AS INTEGER) AS outcome_no, unnest(primary_outcomes) AS outcome FROM trials""")
def q_trial_outcomes(spark, sf_dir):
    return en.trial_outcomes(trials(spark, sf_dir))


@query("entity_mentions", MENTIONS_SQL + "SELECT * FROM mentions")
def q_entity_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query("entity_counts", MENTIONS_SQL + """
SELECT term, count(*) AS mentions, count(DISTINCT doc_id) FILTER (WHERE source_type = 'article') AS publications, count(DISTINCT doc_id) FILTER (WHERE source_type = 'trial') AS trials
FROM mentions GROUP BY 1""")
def q_entity_counts(spark, sf_dir):
    return en.entity_counts(_mentions(spark, sf_dir))


@query("cooccurrence", MENTIONS_SQL + """, m AS (SELECT DISTINCT doc_id, source_type, term FROM mentions)
SELECT a.term AS term_a, b.term AS term_b, count(*) FILTER (WHERE a.source_type = 'article') AS publications, count(*) FILTER (WHERE a.source_type = 'trial') AS trials
FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2""")
def q_cooccurrence(spark, sf_dir):
    return en.cooccurrence(_mentions(spark, sf_dir))


@query("embedding_text", "WITH" + ARTICLES_SQL + "," + TRIALS_SQL.lstrip("\n") + f"""
SELECT 'PMID:' || pmid AS doc_id, md5(trim(title || ' ' || coalesce(abstract, ''), {BLANKS})) AS text_md5,
  md5(substr(coalesce(abstract, ''), 1, 500)) AS snippet_md5 FROM articles
UNION ALL
SELECT 'NCT:' || nct_id, md5(concat_ws(' ', brief_title, array_to_string(conditions, ', '), array_to_string(interventions, ', '))),
  md5(substr(coalesce(concat_ws(' ', array_to_string(conditions, ', '), array_to_string(interventions, ', ')), ''), 1, 500)) FROM trials""")
def q_embedding_text(spark, sf_dir):
    both = ix.index_texts(curated_articles(spark, sf_dir), ARTICLES).unionByName(ix.index_texts(trials(spark, sf_dir), TRIALS))
    return both.select("doc_id", F.md5("embedding_text").alias("text_md5"), F.md5("snippet").alias("snippet_md5"))


@query("point_ids", """
SELECT doc_id, doc_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    substr('89ab', CAST((CAST('0x' || substr(h, 17, 1) AS BIGINT) & 3) + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
  CAST(doc_id AS VARCHAR) AS bare_id
FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_key)) AS h FROM (SELECT doc_id, 'PMID:' || doc_id AS doc_key FROM documents))""")
def q_point_ids(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", fx.doc_key("PMID", F.col("doc_id").cast("string")).alias("doc_key"))
    return keyed.withColumns({"point_id": fx.uuid5("doc_key"), "bare_id": fx.bare_id("doc_key")})


def vectors_sql(source: str, name: str) -> str:
    """Hashed-word unit vectors of ``source(doc_id, embedding_text)`` as rows ``doc_id, slot, v32, unit``."""
    return f"""
{name}_slots AS (
  SELECT doc_id, slot, count(*) AS n FROM (
    SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS slot FROM (
      SELECT doc_id, unnest(string_split_regex(trim(lower(embedding_text), {BLANKS}), '\\s+')) AS token FROM {source}) WHERE token <> '')
  GROUP BY 1, 2),
{name}_32 AS (SELECT doc_id, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS v32 FROM {name}_slots),
{name} AS (SELECT *, v32 / sqrt(sum(v32 * v32) OVER (PARTITION BY doc_id)) AS unit FROM {name}_32)"""


ARTICLE_TEXTS_SQL = f"""
article_texts AS (SELECT 'PMID:' || pmid AS doc_id, trim(title || ' ' || coalesce(abstract, ''), {BLANKS}) AS embedding_text FROM articles)"""


@query("hash_embed", "WITH" + ARTICLES_SQL + "," + ARTICLE_TEXTS_SQL + "," + vectors_sql("article_texts", "vec") + """
SELECT doc_id, CAST(slot AS INTEGER) AS slot, v32 AS value FROM vec""")
def q_hash_embed(spark, sf_dir):
    texts = ix.index_texts(curated_articles(spark, sf_dir), ARTICLES)
    vectors = texts.select("doc_id", embed("embedding_text").alias("vector"))
    long = vectors.select("doc_id", F.posexplode("vector").alias("slot", "value"))
    return long.filter(F.col("value") != 0).withColumn("value", F.col("value").cast("double"))


@query("vector_functions", """
WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, [CAST(label + 1 AS DOUBLE) * x FOR x IN embedding] AS w FROM embeddings),
f AS (SELECT vec_id, v, [x / sqrt(list_sum([y * y FOR y IN w])) FOR x IN w] AS unit, list_reverse(v) AS r FROM e)
SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN unit])), 5) AS unit_norm, round(unit[1], 6) AS first_value,
  round(list_dot_product(v, r) / (sqrt(list_sum([x * x FOR x IN v])) * sqrt(list_sum([x * x FOR x IN r]))), 6) AS reverse_cosine FROM f""")
def q_vector_functions(spark, sf_dir):
    """Norm, unit vector and cosine of every stored vector and its reverse."""
    e = table(spark, sf_dir, "embeddings")
    scaled = e.withColumn("unit", l2_normalise(F.transform("embedding", lambda x: x * (F.col("label") + 1))))
    return scaled.select(
        "vec_id", F.round(l2_norm("unit"), 5).alias("unit_norm"), F.round(F.get("unit", F.lit(0)).cast("double"), 6).alias("first_value"),
        F.round(cosine("embedding", F.reverse("embedding")), 6).alias("reverse_cosine"),
    )


_CENTROIDS_SQL = """
WITH long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label, i, avg(x) AS x FROM long GROUP BY 1, 2),
cn AS (SELECT label, sqrt(sum(x * x)) AS n FROM cent GROUP BY 1),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM long GROUP BY 1),
scores AS (SELECT c.label AS query_id, l.vec_id AS doc_id, any_value(l.label) AS label, round(sum(c.x * l.x) / (any_value(cn.n) * any_value(vn.n)), 6) AS score
  FROM cent c JOIN long l USING (i) JOIN cn ON cn.label = c.label JOIN vn ON vn.vec_id = l.vec_id GROUP BY 1, 2)
"""


def _centroids(spark, sf_dir) -> DataFrame:
    """One question per label: the mean vector of the label, combined per position in the map tasks."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("query_vector")).select(F.col("label").alias("query_id"), "query_vector")


_EMBEDDED = SearchColumns(doc_id="vec_id", vector="embedding")


@query("vector_topk", _CENTROIDS_SQL + """
SELECT query_id, doc_id AS vec_id, score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scores) WHERE r <= 10""")
def q_vector_topk(spark, sf_dir):
    """The ten vectors closest to the mean of each label."""
    return vector_topk(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), 10, _EMBEDDED)


@query("vector_topk_grid", ORACLES["vector_topk"])
def q_vector_topk_grid(spark, sf_dir):
    """The same search with few centers, small slices and small question batches."""
    return vector_topk(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), 10, _EMBEDDED, centers=5, slice_rows=50, batch_questions=3)


@query("vector_shares")
def q_vector_shares(spark, sf_dir):
    """Share of all vectors that the search scores for each question of ``vector_topk``; no more than all of them."""
    clustered = cluster_vectors(table(spark, sf_dir, "embeddings"), _EMBEDDED)
    return scored_shares(clustered, _centroids(spark, sf_dir), 10)


@query("merge_topk", _CENTROIDS_SQL + """
SELECT query_id, doc_id AS vec_id, score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label >= 5, doc_id) AS r FROM scores) WHERE r <= 10""")
def q_merge_topk(spark, sf_dir):
    """Two collections searched apart and merged."""
    e, asked = table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir)
    parts = [vector_topk(e.filter(rule), asked, 10, _EMBEDDED) for rule in ("label < 5", "label >= 5")]
    return merge_topk(parts, 10, doc_id="vec_id")


@query("upsert_points", """
WITH n AS (SELECT vec_id, label + 100 AS label, 'run-2' AS indexing_run_id FROM embeddings WHERE label >= 5
  UNION ALL SELECT vec_id + 1000000, label, 'run-1' FROM embeddings WHERE label = 9)
SELECT vec_id, label, 'run-0' AS indexing_run_id FROM embeddings WHERE label < 5 UNION ALL SELECT * FROM n""")
def q_upsert_points(spark, sf_dir):
    """Half of the points replaced twice (the later run wins) and some new ones added."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    old = e.withColumn("indexing_run_id", F.lit("run-0"))
    late = e.filter("label >= 5")
    new = (
        late.withColumns({"label": F.col("label") + 100, "indexing_run_id": F.lit("run-2")})
        .unionByName(late.withColumns({"label": F.col("label") + 50, "indexing_run_id": F.lit("run-1")}))
        .unionByName(e.filter("label = 9").select((F.col("vec_id") + 1000000).alias("vec_id"), "label", F.lit("run-1").alias("indexing_run_id")))
    )
    return ix.upsert_points(old, new, key="vec_id")


@query("index_documents", "WITH" + ARTICLES_SQL + """
SELECT 'PMID:' || pmid AS doc_id, title, md5(substr(coalesce(abstract, ''), 1, 500)) AS snippet_md5, 'articles' AS collection,
  CASE length(publication_date) WHEN 4 THEN publication_date || '-01-01' WHEN 7 THEN publication_date || '-01' ELSE publication_date END AS date_from,
  CASE length(publication_date) WHEN 4 THEN publication_date || '-12-31'
    WHEN 7 THEN strftime(last_day(CAST(publication_date || '-01' AS DATE)), '%Y-%m-%d') ELSE publication_date END AS date_to,
  CASE WHEN abstract IS NULL THEN 'run-0' ELSE 'run-1' END AS indexing_run_id, 64 AS dimension FROM articles""")
def q_index_documents(spark, sf_dir):
    """An earlier index of all articles, with those that have an abstract indexed again and upserted."""
    articles = curated_articles(spark, sf_dir)
    old = ix.index_articles(articles, "snap-0", ix.IndexRun("run-0"))
    new = ix.index_articles(articles.filter("abstract IS NOT NULL"), SNAPSHOT, ix.IndexRun("run-1"))
    return ix.upsert_points(old, new).select(
        "doc_id", "title", F.md5("snippet").alias("snippet_md5"), "collection", F.col("date_from").cast("string").alias("date_from"),
        F.col("date_to").cast("string").alias("date_to"), "indexing_run_id", F.size("vector").alias("dimension"),
    )


@query("index_drift", "WITH" + ARTICLES_SQL + """
SELECT count(*) AS documents, count(abstract) AS embedded, round(count(*) FILTER (WHERE abstract IS NULL) / count(*), 6) AS missing_share,
  round(count(*) FILTER (WHERE abstract IS NOT NULL AND journal = 'src1') / count(abstract), 6) AS stale_share,
  1.0::DOUBLE AS min_norm, 1.0::DOUBLE AS mean_norm, 1.0::DOUBLE AS max_norm FROM articles""")
def q_index_drift(spark, sf_dir):
    """Articles without an abstract are not indexed, those of one journal only in an older snapshot."""
    articles = curated_articles(spark, sf_dir).withColumn("doc_id", fx.doc_key("PMID", "pmid"))
    indexed = ix.index_articles(articles.filter("abstract IS NOT NULL AND journal <> 'src1'"), SNAPSHOT, ix.IndexRun("run-1"))
    stale = ix.index_articles(articles.filter("abstract IS NOT NULL AND journal = 'src1'"), "snap-0", ix.IndexRun("run-0"))
    drift = ix.index_drift(articles, indexed.unionByName(stale), SNAPSHOT)
    return drift.withColumns({c: F.round(c, 6) for c in ("missing_share", "stale_share")} | {c: F.round(c, 5) for c in ("min_norm", "mean_norm", "max_norm")})


@query("index_coverage", "WITH" + ARTICLES_SQL + """
SELECT 'PMID:' || pmid AS doc_id, CASE WHEN abstract IS NULL THEN 'missing' ELSE 'embedded' END AS state FROM articles""")
def q_index_coverage(spark, sf_dir):
    articles = curated_articles(spark, sf_dir)
    index = ix.index_articles(articles.filter("abstract IS NOT NULL"), SNAPSHOT, ix.IndexRun("run-1"))
    keyed = articles.select(fx.doc_key("PMID", "pmid").alias("doc_id"))
    embedded, missing = ix.coverage(keyed, index)
    return embedded.withColumn("state", F.lit("embedded")).unionByName(missing.withColumn("state", F.lit("missing")))
