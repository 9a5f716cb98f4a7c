"""From questions to reviewed, cited answers and manifests, for a whole batch of questions in one plan.

Every step adds columns to one row per question. The only per-question groups are its hits, at most ``k`` of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as fx
from larkspur.functions.render import SECTION_LABELS, citation_badge, citation_detail, score_text
from larkspur.functions.vectors import Encoder, embed, hash_encoder
from larkspur.operators.search import ClusteredVectors, SearchColumns, attach_payload, cluster_vectors, fill_content, only_keys, search
from larkspur.session import written

# Hits per question, researched documents in the evidence section, revisions before giving up, and how
# long a manifest can be looked up.
QUESTION_LIMIT = 5
EVIDENCE_DOCS = 3
MAX_REVISIONS = 2
MANIFEST_TTL_HOURS = 24

# The steps of an approved question; a rejected one repeats research and review once.
STEPS_APPROVED = (
    "cmo_router", "medical_librarian", "clinical_biostatistician", "lead_researcher", "peer_reviewer", "finalize",
)
STEPS_REJECTED = STEPS_APPROVED[:5] + STEPS_APPROVED[3:]

# Answer texts.
NO_DOCUMENTS = "No relevant documents found in the knowledge base."
NO_STATISTICS = "No statistical data available."
NO_ANSWER = (
    "Insufficient evidence to provide a substantive answer. Consider broadening the search query or filters."
)
NO_FEATURES = "Feature data not available for retrieved documents."
NO_CITATIONS = "No citations found. Answer must be backed by retrieved evidence."

PAYLOAD = ("title", "snippet", "content", "source_type", "snapshot_ref", "indexing_run_id")

QUESTION_SEARCH = SearchColumns(
    equal=(("source_type", "source_type"),), dates=("date_from", "date_to", "date_from", "date_to"),
    within=(("collection", "collections"),), limit="search_limit",
)


def route_questions(
    questions: DataFrame, trial_words: Iterable[str] = fx.TRIAL_WORDS, article_words: Iterable[str] = fx.ARTICLE_WORDS
) -> DataFrame:
    """Add ``search_query``, ``search_limit`` and the implied ``source_type`` to questions.

    Optional columns of the user are kept and win: the filters ``source_type, date_from, date_to``, the limit ``search_limit`` and
    the list ``collections``.
    """
    have = set(questions.columns)
    given = F.col("source_type") if "source_type" in have else None
    dates = {c: F.col(c).cast("date") if c in have else F.lit(None).cast("date") for c in ("date_from", "date_to")}
    return questions.withColumns(
        {
            "search_query": fx.search_terms("question"),
            "search_limit": F.coalesce(F.col("search_limit").cast("int"), F.lit(QUESTION_LIMIT)) if "search_limit" in have else F.lit(QUESTION_LIMIT),
            "collections": F.col("collections").cast("array<string>") if "collections" in have else F.lit(None).cast("array<string>"),
            "source_type": fx.implied_source_type("question", given, trial_words, article_words),
            **dates,
        }
    )


@dataclass(frozen=True)
class Retrieved:
    """Hits with payload, and the bare hit keys."""

    hits: DataFrame
    keys: DataFrame


def retrieve(
    routed: DataFrame, index: DataFrame, k: int = QUESTION_LIMIT, encoder: Encoder = hash_encoder,
    staged: DataFrame | None = None, staged_text: Column | None = None, clustered: ClusteredVectors | None = None, **limits,
) -> Retrieved:
    """The best index rows per routed question, with payload and filled content.

    A question has its own ``search_limit`` (else ``k``) and its own ``collections``; without any it searches all. The best of several
    collections are the best of their merged best lists. ``clustered`` is the index in cells, where it is kept. The hits
    are written to the shared folder once, because payload, staged text and features are all looked up by them and
    the vectors should be scanned a single time. ``staged_text`` reads the text from the columns of ``staged``; it is
    evaluated for hits only.
    """
    missing = {"collections": "array<string>", "search_limit": "int"}
    routed = routed.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in routed.columns})
    asked = routed.withColumn("query_vector", embed("search_query", encoder))
    cells = clustered if clustered is not None else cluster_vectors(index, QUESTION_SEARCH, **limits)
    keys = written(search(cells, asked, k), "hits")
    hits = attach_payload(keys, index, PAYLOAD)
    if staged is not None:
        staged = only_keys(staged, keys)
    return Retrieved(fill_content(hits, staged, staged_text), keys)


def enrich(retrieved: Retrieved, article_features: DataFrame, trial_features: DataFrame) -> DataFrame:
    """Features of each hit by source type, null where there are none.

    Both feature tables are brought to one shape keyed by document id and cut to the hits, then met in one left join.
    """
    def shape(df: DataFrame, prefix: str, key: str, lead: str, columns: tuple[str, ...]) -> DataFrame:
        fields = [(F.col(n) if n in columns else F.lit(None)).cast("long").alias(n) for n in NUMBERS]
        known = df.filter(F.col(lead).isNotNull())
        return known.select(fx.doc_key(prefix, key).alias("doc_id"), F.struct(*fields).alias("features"))

    articles = shape(article_features, "PMID", "pmid", "title_word_count", ("abstract_word_count", "publication_year"))
    trials = shape(trial_features, "NCT", "nct_id", "sample_size", ("sample_size", "has_outcomes"))
    features = only_keys(articles.unionByName(trials), retrieved.keys)
    return retrieved.hits.join(features, "doc_id", "left")


# Names of the feature values that answers print, in print order.
NUMBERS = ("sample_size", "abstract_word_count", "publication_year", "has_outcomes")


def collect_docs(questions: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row per question with its hits as ``docs`` in rank order, and the two counts. At most k hits per question."""
    doc = F.struct(
        "rank", "doc_id", "source_type", "snippet", "score", "title", "content", "snapshot_ref", "features"
    )
    grouped = enriched.groupBy("query_id").agg(
        F.array_sort(F.collect_list(doc)).alias("docs"),
        F.count(F.lit(1)).alias("retrieved_doc_count"),
        F.count("features").alias("feature_enriched_count"),
    )
    zero = F.lit(0).cast("long")
    joined = questions.join(grouped, "query_id", "left")
    empty = F.array().cast(grouped.schema["docs"].dataType)
    return joined.withColumns(
        {
            "docs": F.coalesce("docs", empty),
            "retrieved_doc_count": F.coalesce("retrieved_doc_count", zero),
            "feature_enriched_count": F.coalesce("feature_enriched_count", zero),
        }
    )


def build_citations(docs: DataFrame) -> DataFrame:
    """Add ``citations``: seven fields per hit, in rank order."""
    def cite(d: Column) -> Column:
        return F.struct(
            d["doc_id"].alias("id"), F.coalesce(d["source_type"], F.lit("")).alias("type"),
            F.coalesce(d["snippet"], F.lit("")).alias("snippet"), F.coalesce(d["score"], F.lit(0.0)).alias("score"),
            F.coalesce(d["title"], F.lit("")).alias("title"), F.coalesce(d["content"], F.lit("")).alias("content"),
            F.coalesce(d["snapshot_ref"], F.lit("")).alias("snapshot_ref"),
        )

    return docs.withColumn("citations", F.transform("docs", cite))


def _statistics(docs: Column) -> Column:
    """``id: n=12; id: year=2020`` over all hits; zero and unknown values are left out."""
    labels = {"sample_size": "n=", "abstract_word_count": "abstract_words=", "publication_year": "year="}

    def parts(d: Column) -> Column:
        values = [
            F.when(d["features"][n] != 0, F.concat(d["doc_id"], F.lit(": " + label), d["features"][n].cast("string")))
            for n, label in labels.items()
        ]
        flag = F.when(d["features"]["has_outcomes"] != 0, F.concat(d["doc_id"], F.lit(": has_outcomes=True")))
        return F.array(*values, flag)

    found = F.filter(F.flatten(F.transform(docs, parts)), lambda x: x.isNotNull())
    return F.nullif(F.array_join(found, "; "), F.lit(""))


def synthesise_answers(cited: DataFrame) -> DataFrame:
    """Add ``answer``: background, evidence, statistics and conclusion, by fixed templates."""
    docs, n = F.col("docs"), F.size("docs").cast("string")
    none = F.size("docs") == 0
    best = F.try_element_at(docs, F.lit(1))
    question = F.coalesce(F.col("question"), F.lit(""))
    evidence = F.array_join(
        F.transform(
            F.slice(docs, 1, EVIDENCE_DOCS),
            lambda d: F.concat(F.lit("["), d["doc_id"], F.lit("] "), F.coalesce(d["snippet"], F.lit("(no snippet)"))),
        ),
        " | ",
    )
    conclusion = F.concat(
        F.lit("Based on "), n, F.lit(" document(s) (top relevance score: "), score_text(best["score"]),
        F.lit("), the retrieved evidence addresses the query. Primary reference: "), best["doc_id"], F.lit(" — "),
        F.coalesce(best["title"], F.lit("N/A")), F.lit("."),
    )
    background = F.concat(
        F.lit("Analysis of "), n, F.lit(" retrieved biomedical document(s) relevant to: "), question
    )
    return cited.withColumn(
        "answer",
        F.struct(
            F.when(none, F.concat(F.lit("Query: "), question)).otherwise(background).alias("background"),
            F.when(none, F.lit(NO_DOCUMENTS)).otherwise(evidence).alias("evidence"),
            F.when(none, F.lit(NO_STATISTICS)).otherwise(F.coalesce(_statistics(docs), F.lit(NO_FEATURES))).alias("statistics"),
            F.when(none, F.lit(NO_ANSWER)).otherwise(conclusion).alias("conclusion"),
        ),
    )


def review(answered: DataFrame) -> DataFrame:
    """Add ``review_status`` and ``review_feedback``: the first broken rule rejects."""
    blank = F.filter("citations", lambda c: fx.is_blank(c["snippet"]))
    sections = F.filter(
        F.array(*[F.when(fx.is_blank(F.col("answer")[s]), F.lit(f"'{s}'")) for s in SECTION_LABELS]),
        lambda s: s.isNotNull(),
    )
    feedback = (
        F.when(F.size("citations") == 0, F.lit(NO_CITATIONS))
        .when(
            F.size(blank) > 0,
            F.concat(F.size(blank).cast("string"), F.lit(" citation(s) have empty snippets: "), F.array_join(F.transform(blank, lambda c: c["id"]), ", ")),
        )
        .when(F.size(sections) > 0, F.concat(F.lit("Answer section(s) missing or empty: ["), F.array_join(sections, ", "), F.lit("]")))
        .otherwise(F.lit(""))
    )
    return answered.withColumn("review_feedback", feedback).withColumn(
        "review_status", F.when(F.col("review_feedback") == "", "approved").otherwise("rejected")
    )


def revision_outcome(reviewed: DataFrame) -> DataFrame:
    """Add ``revision_count`` and ``steps``.

    A repeated answer is the same answer, so a rejected question stays rejected until the revisions are used up.
    """
    approved = F.col("review_status") == "approved"
    names = {True: STEPS_APPROVED, False: STEPS_REJECTED}
    return reviewed.withColumns(
        {
            "revision_count": F.when(approved, 1).otherwise(MAX_REVISIONS),
            "steps": F.when(approved, F.array(*[F.lit(s) for s in names[True]])).otherwise(F.array(*[F.lit(s) for s in names[False]])),
        }
    )


def refusals(reviewed: DataFrame) -> DataFrame:
    """Questions without citations: reason and missing kinds of evidence, kept like answers."""
    return reviewed.filter(F.size("citations") == 0).select(
        "query_id", "question",
        F.lit("DQ-UI-1").alias("refusal_rule"),
        F.lit(NO_CITATIONS).alias("refusal_reason"),
        F.when(F.col("source_type").isNull(), F.array(F.lit("article"), F.lit("trial"))).otherwise(F.array("source_type")).alias("missing_evidence"),
    )


def answer_questions(questions: DataFrame, index: DataFrame, article_features: DataFrame, trial_features: DataFrame, **options) -> DataFrame:
    """The whole chain from questions to reviewed answers."""
    routed = route_questions(questions)
    hits = enrich(retrieve(routed, index, **options), article_features, trial_features)
    cited = build_citations(collect_docs(routed, hits))
    return revision_outcome(review(synthesise_answers(cited)))


def build_manifests(reviewed: DataFrame, created_at: Column) -> DataFrame:
    """Twelve-field manifests of answered questions; the id follows from the query id, so a replay finds it again.

    ``execution_timeline`` is taken from the input where it has one.
    """
    empty = F.array().cast("array<struct<step:string,started_at:string,elapsed_ms:bigint>>")
    timeline = F.coalesce("execution_timeline", empty) if "execution_timeline" in reviewed.columns else empty
    return reviewed.filter(F.size("citations") > 0).select(
        fx.uuid5(F.concat(F.lit("manifest:"), F.col("query_id").cast("string"))).alias("manifest_id"),
        "query_id", "question", F.struct("source_type", "date_from", "date_to").alias("filters"), "answer", "citations",
        "review_status", "review_feedback", "retrieved_doc_count", "feature_enriched_count",
        timeline.alias("execution_timeline"), created_at.alias("created_at"),
    )


def audit_lookup(ids: DataFrame, manifests: DataFrame, now: Column, ttl_hours: int = MANIFEST_TTL_HOURS) -> DataFrame:
    """Manifests of the asked ids (``manifest_id``); ``found`` is false for unknown and expired ones."""
    live = manifests.filter(F.col("created_at") > now - F.expr(f"INTERVAL {ttl_hours} HOURS"))
    return ids.join(live, "manifest_id", "left").withColumns(
        {
            "found": F.col("query_id").isNotNull(),
            "execution_timeline": F.coalesce("execution_timeline", F.array().cast(live.schema["execution_timeline"].dataType)),
        }
    )


def replay_diff(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Hits that differ between a stored and a replayed run (columns ``query_id, doc_id, rank, score``)."""
    a, b = stored.alias("a"), replayed.alias("b")
    same_key = F.col("a.query_id").eqNullSafe(F.col("b.query_id")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    same = F.col("a.score").eqNullSafe(F.col("b.score")) & F.col("a.rank").eqNullSafe(F.col("b.rank"))
    return a.join(b, same_key, "full").filter(~same).select(
        F.coalesce("a.query_id", "b.query_id").alias("query_id"), F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"),
        F.col("a.score").alias("stored_score"), F.col("b.score").alias("replayed_score"),
        F.when(F.col("a.doc_id").isNull(), "added").when(F.col("b.doc_id").isNull(), "removed").otherwise("changed").alias("difference"),
    )


def citation_rows(cited: DataFrame) -> DataFrame:
    """One row per citation with its position."""
    return cited.select("query_id", F.posexplode("citations").alias("position", "c")).select("query_id", "position", "c.*")


def unresolved_citations(citations: DataFrame, curated_keys: DataFrame) -> DataFrame:
    """Citations whose document is not in the snapshot they name (``doc_id, snapshot_ref`` of curated rows)."""
    keys = curated_keys.select(F.col("doc_id").alias("id"), "snapshot_ref")
    return citations.join(keys, ["id", "snapshot_ref"], "left_anti")


def answer_sections(answered: DataFrame) -> DataFrame:
    """Four ordered rows per answer: ``query_id, position, label, section_text``."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("label"), F.coalesce(F.col("answer")[key], F.lit("")).alias("section_text"))
        for key, label in SECTION_LABELS.items()
    ])
    return answered.select("query_id", F.posexplode(rows).alias("position", "s")).select("query_id", "position", "s.*")


def claim_map(answered: DataFrame) -> DataFrame:
    """Which citations each section rests on: all for the background, the first ones for the evidence, those with
    features for the statistics and the best for the conclusion."""
    uses = {
        "background": F.col("docs"),
        "evidence": F.slice("docs", 1, EVIDENCE_DOCS),
        "statistics": F.filter("docs", lambda d: d["features"].isNotNull()),
        "conclusion": F.slice("docs", 1, 1),
    }

    def claims_of(section: str, docs: Column) -> Column:
        return F.transform(docs, lambda d: F.struct(
            F.lit(section).alias("claim_ref"), d["doc_id"].alias("doc_id"), d["snippet"].alias("snippet"),
            d["snapshot_ref"].alias("snapshot_ref"),
        ))

    claims = F.flatten(F.array(*[claims_of(section, docs) for section, docs in uses.items()]))
    return answered.select("query_id", F.inline(claims))


def evidence_items(answered: DataFrame, view_version: str, value_time: Column) -> DataFrame:
    """Document items and statistical items of each answer in one table."""
    doc_rows = answered.select("query_id", F.explode("docs").alias("d"))
    documents = doc_rows.select(
        "query_id", F.lit("document").alias("kind"), F.col("d.doc_id").alias("doc_id"), F.lit("snippet").alias("name"),
        F.sha2("d.snippet", 256).alias("value"), F.lit(None).cast("timestamp_ntz").alias("value_time"),
        F.lit(None).cast("string").alias("view_version"), F.col("d.snapshot_ref").alias("snapshot_ref"),
    )
    values = F.array(*[F.struct(F.lit(n).alias("name"), F.col("d.features")[n].alias("number")) for n in NUMBERS])
    statistics = (
        doc_rows.filter(F.col("d.features").isNotNull())
        .select("query_id", F.col("d.doc_id").alias("doc_id"), F.col("d.snapshot_ref").alias("snapshot_ref"), F.inline(values))
        .filter(F.col("number").isNotNull())
        .select(
            "query_id", F.lit("statistic").alias("kind"), "doc_id", "name", F.col("number").cast("string").alias("value"),
            value_time.cast("timestamp_ntz").alias("value_time"), F.lit(view_version).alias("view_version"), "snapshot_ref",
        )
    )
    return documents.unionByName(statistics)


def citation_text(cited: DataFrame) -> DataFrame:
    """Badge and detail text of every citation."""
    return cited.select("query_id", F.posexplode("citations").alias("position", "c")).select(
        "query_id", "position", citation_badge(F.col("c")).alias("badge"), citation_detail(F.col("c")).alias("detail")
    )
