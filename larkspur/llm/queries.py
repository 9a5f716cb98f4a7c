"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import align, classlm, decontam, langid, linededup, mixing, neardup, quality_rank, runs, tokens_out, topk, toxicity, urls
from larkspur.llm.common import fold_of, table
from larkspur.plans.register import new_register
from larkspur.session import workspace

QUERIES, ORACLES, query = new_register()

#: The tokenizer in use, one of the public ones.
TOKENIZER = "byte_bpe_50k.json"

HOST_RULES = [
    urls.HostRule("net", "/", "block"),
    urls.HostRule("example.net", "/en/", "allow"),
    urls.HostRule("example.com", "/de/", "block"),
    urls.HostRule("org", "/fr/", "allow"),
]
#: Where no host rule fits: hosts that name themselves spam.
GLOB_RULES = [urls.GlobRule("*spam-farm.*", "block"), urls.GlobRule("*cheap-pills.*", "block")]

_LANGUAGES = {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.12}
_SOURCES = {"src0": 0.28, **{f"src{i}": 0.0375 for i in range(1, 20)}}
_TOPICS = {"short": 0.08, "medium": 0.44, "long": 0.48}


def marginals() -> list[mixing.Marginal]:
    """Target shares of tokens by source, language and length topic."""
    topic = mixing.length_topic(mixing.word_count(F.col("text")))
    return [mixing.Marginal("source", F.col("source"), _SOURCES), mixing.Marginal("lang", F.col("lang"), _LANGUAGES), mixing.Marginal("topic", topic, _TOPICS)]


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


@query("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, offsets and checksums of every document, read back from the files."""
    path = workspace(spark, "llm-tokens")
    tokens_out.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens_out.read_token_files(spark, path)


_URL_SQL = """
WITH located AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM located LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule,
  CASE WHEN v IS NOT NULL THEN v WHEN contains(host || path, 'spam-farm.') OR contains(host || path, 'cheap-pills.') THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""


@query("op2_url_filter", _URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES, GLOB_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op3_quality_rank")
def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt outside the held-out fold."""
    docs, labels, fold = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5)
    model = quality_rank.train_quality(docs, labels.filter(fold != 0), "quality")
    scored = quality_rank.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query("op4_exact_topk", _TOPK_SQL)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best matches of every 50th vector among all vectors."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document with its offending sentences; learnt outside the held-out fold."""
    docs, labels, fold = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4)
    model = toxicity.train_toxicity(docs, labels.filter(fold != 2), "toxic")
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", "predicted", F.to_json("offending").alias("offending"))


@query("op6_source_mixing")
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents with their tokens and calibrated probability."""
    docs = table(spark, sf_dir, "documents")
    rated = mixing.with_probabilities(docs, marginals(), mixing.word_count(F.col("text")))
    return mixing.draw(rated, F.col("doc_id")).select("doc_id", "source", "lang", "mix_tokens", "mix_probability")


@query("op7_class_lm")
def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the class model and the unigram base; learnt outside the held-out fold."""
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of(F.col("doc_id"), 7)
    model, counts = classlm.train(docs.filter(fold != 2))
    scored = classlm.score(docs, model, counts)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op8_language_codes")
def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt outside the held-out fold."""
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold_of(F.col("doc_id"), 4)
    model = langid.train_languages(docs.filter(fold != 2))
    judged = langid.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count, component and fate of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_LEAK_SQL = r"""
WITH
iw AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
it AS (SELECT item_id, len(w) - 4 AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS s FROM iw WHERE len(w) >= 5),
ic AS (SELECT item_id, n, sh, count(*) AS k FROM (SELECT item_id, n, unnest(s) AS sh FROM it) GROUP BY ALL),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
dp AS (SELECT doc_id, len(w) - 4 AS m, unnest(range(1, len(w) - 3)) AS p, w FROM dw WHERE len(w) >= 5),
ds AS (SELECT doc_id, m, p - 1 AS pos, array_to_string(w[p:p+4], ' ') AS sh FROM dp),
hit AS (SELECT DISTINCT doc_id, m, pos, sh, item_id, n, k FROM ds JOIN ic USING (sh)),
enough AS (SELECT doc_id, item_id FROM hit GROUP BY ALL HAVING count(*) >= ceil(75 * (any_value(n) + least(any_value(m), any_value(n))) / 175.0)),
h AS (SELECT hit.*, least(m, n) AS size FROM hit JOIN enough USING (doc_id, item_id)),
st AS (SELECT DISTINCT doc_id, item_id, n, size, unnest(range(greatest(0, pos - size + 1), least(pos, m - size) + 1)) AS start FROM h),
inw AS (SELECT st.doc_id, st.item_id, st.n, st.size, st.start, h.sh, h.k, count(*) AS t FROM st JOIN h ON st.doc_id = h.doc_id AND st.item_id = h.item_id AND st.n = h.n AND h.pos BETWEEN st.start AND st.start + st.size - 1 GROUP BY ALL),
sm AS (SELECT doc_id, item_id, n, size, start, sum(least(t, k)) AS same FROM inw GROUP BY ALL),
ok AS (SELECT * FROM sm WHERE 100 * same >= 75 * (n + size - same)),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY same DESC, start, size DESC, n) AS r FROM ok)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS n_shingles, same / CAST(n + size - same AS DOUBLE) AS similarity FROM rk WHERE r = 1
"""


@query("op10_decontamination", _LEAK_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with its best window."""
    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_RUNS_SQL = r"""
WITH ids AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)), lambda c, b: list_reduce(
      list_prepend(xor(c, b), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) AS h
  FROM documents),
cut AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM ids),
words AS MATERIALIZED (
  SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] WHEN a IS NULL THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM cut)),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
found AS (
  SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island)
  WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM found GROUP BY doc_id),
best AS (
  SELECT f.* FROM found f ANTI JOIN found g
    ON f.doc_id = g.doc_id AND (g.length * f.period > f.length * g.period OR (g.length * f.period = f.length * g.period AND (g.start < f.start OR (g.start = f.start AND g.period < f.period)))))
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_periodic_runs", _RUNS_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, strongest and digest of the periodic runs of every document, and a digest of its words without the repeats."""
    docs = runs.with_repeated_tail(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs).withColumn("top", runs.strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    milli = F.expr("1000 * top.length div top.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers, and how its links rank in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.alignment(docs, tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e),
s AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > first_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first_id IS NULL OR doc_id = first_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key)
GROUP BY doc_id
"""


@query("op13_line_dedup", _LINES_SQL)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them an earlier document keeps, and a digest of the rest."""
    kept = linededup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
