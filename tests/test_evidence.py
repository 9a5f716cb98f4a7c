import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.operators import evidence as ev
from larkspur.operators import index as ix
from larkspur.operators import quality as dq
from larkspur.operators import reports as rp
from larkspur.session import workspace
from larkspur.sources.snapshots import SnapshotStore
from larkspur.sources.specs import ARTICLES, TRIALS

DOC = "struct<rank:int,doc_id:string,source_type:string,snippet:string,score:double,title:string,content:string,snapshot_ref:string,features:struct<sample_size:bigint,abstract_word_count:bigint,publication_year:bigint,has_outcomes:bigint>>"


def doc(rank, doc_id, snippet="snip", score=0.9, title="T", kind="article", features=None):
    return (rank, doc_id, kind, snippet, score, title, "content", "snap", features)


@pytest.fixture
def answer(spark):
    def run(docs, question="Q?", source_type=None):
        df = spark.createDataFrame([(1, question, source_type, None, None, docs)], f"query_id INT, question STRING, source_type STRING, date_from DATE, date_to DATE, docs ARRAY<{DOC}>")
        df = df.withColumns({"retrieved_doc_count": F.size("docs").cast("long"), "feature_enriched_count": F.lit(0).cast("long")})
        return ev.revision_outcome(ev.review(ev.synthesise_answers(ev.build_citations(df))))

    return run


def test_no_documents(answer):
    r = answer([]).first()
    assert r["answer"]["background"] == "Query: Q?" and r["answer"]["evidence"] == "No relevant documents found in the knowledge base."
    assert r["answer"]["statistics"] == "No statistical data available." and r["answer"]["conclusion"].startswith("Insufficient evidence")
    assert (r["review_status"], r["review_feedback"]) == ("rejected", "No citations found. Answer must be backed by retrieved evidence.")
    assert (r["revision_count"], len(r["steps"])) == (2, 8)


def test_answer_text(answer):
    docs = [doc(1, "PMID:1", features=(None, 120, 2020, None)), doc(2, "NCT:2", None, 0.5, kind="trial", features=(45, None, None, 1)),
            doc(3, "PMID:3", "", features=(None, 0, 0, None)), doc(4, "PMID:4", "x", features=(-1, None, None, 0))]
    r = answer(docs).first()
    assert r["answer"]["background"] == "Analysis of 4 retrieved biomedical document(s) relevant to: Q?"
    assert r["answer"]["evidence"] == "[PMID:1] snip | [NCT:2] (no snippet) | [PMID:3] "
    assert r["answer"]["statistics"] == "PMID:1: abstract_words=120; PMID:1: year=2020; NCT:2: n=45; NCT:2: has_outcomes=True; PMID:4: n=-1"
    assert r["answer"]["conclusion"] == (
        "Based on 4 document(s) (top relevance score: 0.900), the retrieved evidence addresses the query. Primary reference: PMID:1 — T.")
    assert r["review_feedback"] == "2 citation(s) have empty snippets: NCT:2, PMID:3"
    assert r["citations"][1]["snippet"] == "" and list(r["citations"][0].asDict()) == ["id", "type", "snippet", "score", "title", "content", "snapshot_ref"]


def test_approved(answer):
    r = answer([doc(1, "PMID:1", title=None)]).first()
    assert (r["review_status"], r["review_feedback"], r["revision_count"], len(r["steps"])) == ("approved", "", 1, 6)
    assert r["answer"]["statistics"] == "Feature data not available for retrieved documents." and r["answer"]["conclusion"].endswith("PMID:1 — N/A.")


def test_empty_sections_are_named(spark):
    answer = "struct<background:string,evidence:string,statistics:string,conclusion:string>"
    df = spark.createDataFrame([([("a", "s")], (" ", "e", None, "c"))], f"citations ARRAY<STRUCT<id:STRING,snippet:STRING>>, answer {answer}")
    assert ev.review(df).first()["review_feedback"] == "Answer section(s) missing or empty: ['background', 'statistics']"


def test_refusal(answer):
    r = ev.refusals(answer([])).first()
    assert r["refusal_rule"] == "DQ-UI-1" and r["missing_evidence"] == ["article", "trial"]
    assert ev.refusals(answer([], source_type="trial")).first()["missing_evidence"] == ["trial"]
    assert ev.refusals(answer([doc(1, "PMID:1")])).count() == 0


def test_views(answer):
    reviewed = answer([doc(1, "PMID:1", " ", 0.5, ""), doc(2, "PMID:2", "b", 0.9)])
    digest = rp.source_digest(reviewed).first()["digest"]
    assert digest == "### 📄 Summary of Retrieved Documentation Content\n\n**[1] T (PMID:2)**\n> b\n"
    listed = rp.documents_by_score(ev.citation_rows(reviewed)).orderBy("source_no").collect()
    assert [(r["source_no"], r["id"], r["title"]) for r in listed] == [(1, "PMID:2", "T"), (2, "PMID:1", "PMID:1")]
    texts = {r["position"]: r["detail"] for r in ev.citation_text(reviewed).collect()}
    assert texts[1] == "**[article] PMID:2** (score: 0.900)\n*T*\n> b\n\n**Full Content:**\ncontent\n\nsnapshot: `snap`"
    assert [r["label"] for r in ev.answer_sections(reviewed).orderBy("position").collect()] == ["Background", "Evidence", "Statistics", "Conclusion"]
    none = answer([])
    assert rp.source_digest(none).first()["digest"] == "No documentation content found."
    assert rp.source_digest(answer([doc(1, "a", " ")])).first()["digest"] == "No substantive snippets found in retrieved documentation."


def test_manifest_round_trip(spark, answer):
    at = dt.datetime(2024, 5, 1)
    manifests = ev.build_manifests(answer([doc(1, "PMID:1")]), F.lit(at).cast("timestamp"))
    first = manifests.first()
    assert first["execution_timeline"] == [] and first["manifest_id"] == ev.build_manifests(answer([doc(1, "x")]), F.lit(at)).first()["manifest_id"]
    assert len(manifests.columns) == 12 and ev.build_manifests(answer([]), F.lit(at)).count() == 0
    ids = spark.createDataFrame([(first["manifest_id"],), ("nope",)], "manifest_id STRING")

    def found(hours):
        looked = ev.audit_lookup(ids, manifests, F.lit(at + dt.timedelta(hours=hours)).cast("timestamp"))
        return {r["manifest_id"]: (r["found"], r["execution_timeline"]) for r in looked.collect()}

    assert found(23) == {first["manifest_id"]: (True, []), "nope": (False, [])}
    assert found(25)[first["manifest_id"]][0] is False


def test_timeline_defaults(spark):
    df = spark.createDataFrame([("m", [("cmo_router", "t", 5), (None, None, None)])], "manifest_id STRING, execution_timeline ARRAY<STRUCT<step:STRING,started_at:STRING,elapsed_ms:BIGINT>>")
    assert [tuple(r)[1:] for r in rp.timeline_table(df).orderBy("position").collect()] == [(0, "CMO Router", 5, "t"), (1, "?", 0, "")]


def test_answer_contracts(spark):
    citation = "ARRAY<STRUCT<id:STRING,type:STRING,snippet:STRING>>"
    df = spark.createDataFrame([(1, [], None, True), (2, [("a", "article", "s")], None, False), (3, [], "no evidence", True)],
                               f"query_id INT, citations {citation}, refusal_reason STRING, manifest_found BOOLEAN")
    got = {(r["rule_id"], r["record_id"]) for r in dq.row_violations(df, dq.answer_rules(), F.col("query_id")).collect()}
    assert got == {("DQ-UI-1", "1"), ("DQ-UI-4", "1"), ("DQ-UI-5", "2"), ("DQ-UI-1", "3")}
    cited = spark.createDataFrame([("a", "article", "s"), (None, "blog", " ")], "id STRING, type STRING, snippet STRING")
    assert [r["message"] for r in dq.row_violations(cited, dq.citation_rules(), F.col("id")).collect()] == ["Bad citation fields: ['id', 'type', 'snippet']"]
    lines = spark.createDataFrame([('data: {"agent":"a","status":"s","summary":"x"}',), ('data: {"agent":"a"}',), ("noise",)], "line STRING")
    assert dq.row_violations(lines, dq.event_rules(), F.col("line")).count() == 2


@pytest.fixture(scope="module")
def lake(spark):
    """Two snapshots of an index with articles and trials, and feature tables."""
    store = SnapshotStore(spark, workspace(spark, "replay"))
    articles = spark.createDataFrame([("1", "aspirin stroke", "aspirin lowers stroke risk", "2020-05"), ("2", "diabetes", "metformin and diabetes", "2021")],
                                     "pmid STRING, title STRING, abstract STRING, publication_date STRING")
    trials = spark.createDataFrame([("NCT1", "aspirin trial", ["stroke"], ["aspirin"], "2022-01-01")],
                                   "nct_id STRING, brief_title STRING, conditions ARRAY<STRING>, interventions ARRAY<STRING>, start_date STRING")
    for name, rows, day in (("s1", articles, 1), ("s2", articles.filter("pmid = '2'"), 2)):
        points = ix.index_rows(rows, ARTICLES, name, ix.IndexRun(name)).unionByName(ix.index_rows(trials, TRIALS, name, ix.IndexRun(name)))
        store.write("index", points, name, dt.datetime(2024, 1, day))
    return store


QUESTIONS = [(1, "What is the effect of aspirin on stroke?", None), (2, "any clinical trial of aspirin", None), (3, "aspirin", "registry")]


def test_question_to_answer(spark, lake):
    questions = spark.createDataFrame(QUESTIONS, "query_id INT, question STRING, source_type STRING")
    articles = spark.createDataFrame([("1", 2, 4, 2020)], "pmid STRING, title_word_count INT, abstract_word_count INT, publication_year INT")
    trials = spark.createDataFrame([("NCT1", 50, 1)], "nct_id STRING, sample_size INT, has_outcomes INT")
    index = lake.read("index", snapshot_id="s1")
    expect = {1: ("PMID:1", 3, 2, "approved"), 2: ("NCT:NCT1", 1, 1, "approved"), 3: (None, 0, 0, "rejected")}
    for options in ({}, {"centers": 2, "slice_rows": 1}):
        got = ev.answer_questions(questions, index, articles, trials, **options).collect()
        assert {r["query_id"]: (r["docs"][0]["doc_id"] if r["docs"] else None, r["retrieved_doc_count"], r["feature_enriched_count"], r["review_status"]) for r in got} == expect
    trial = next(r for r in got if r["query_id"] == 2)
    assert trial["answer"]["statistics"] == "NCT:NCT1: n=50; NCT:NCT1: has_outcomes=True"


def test_replay(spark, lake):
    questions = spark.createDataFrame(QUESTIONS, "query_id INT, question STRING, source_type STRING")

    def run(**which):
        return ev.retrieve(ev.route_questions(questions), lake.read("index", **which)).keys

    recorded = run(snapshot_id="s1")
    assert ev.replay_diff(recorded, run(as_of=dt.datetime(2024, 1, 1))).count() == 0
    changed = ev.replay_diff(recorded, run()).filter("difference = 'removed'").collect()
    assert [(r["query_id"], r["doc_id"]) for r in changed] == [(1, "PMID:1")]


def test_date_filter(spark, lake):
    questions = spark.createDataFrame([(1, "aspirin", dt.date(2020, 5, 20), dt.date(2021, 6, 1)), (2, "aspirin", dt.date(2021, 12, 31), None)],
                                      "query_id INT, question STRING, date_from DATE, date_to DATE")
    hits = ev.retrieve(ev.route_questions(questions), lake.read("index", snapshot_id="s1")).keys.collect()
    assert {(r["query_id"], r["doc_id"]) for r in hits} == {(1, "PMID:1"), (1, "PMID:2"), (2, "PMID:2"), (2, "NCT:NCT1")}


def test_unresolved(spark):
    cited = spark.createDataFrame([(1, "a", "s1"), (1, "a", "s2"), (1, "b", "s1")], "query_id INT, id STRING, snapshot_ref STRING")
    keys = spark.createDataFrame([("a", "s1")], "doc_id STRING, snapshot_ref STRING")
    assert sorted((r["id"], r["snapshot_ref"]) for r in ev.unresolved_citations(cited, keys).collect()) == [("a", "s2"), ("b", "s1")]
