import datetime as dt

from larkspur.operators import jobs
from larkspur.operators.index import IndexRun
from larkspur.session import workspace
from larkspur.sources.snapshots import SnapshotStore
from larkspur.sources.specs import ARTICLES, TRIALS

T0 = dt.datetime(2024, 1, 1)
ARTICLE = "pmid STRING, title STRING, abstract STRING, publication_date STRING, journal STRING"
TRIAL = "nct_id STRING, brief_title STRING, conditions ARRAY<STRING>, interventions ARRAY<STRING>, primary_outcomes ARRAY<STRING>, sample_size INT, status STRING, start_date STRING"


def test_refresh_jobs(spark):
    store = SnapshotStore(spark, workspace(spark, "jobs"))
    store.write("curated_articles", spark.createDataFrame([("1", "a b", "x", "2024", "J"), ("2", "c", None, None, None)], ARTICLE), "a1", T0)
    store.write("curated_trials", spark.createDataFrame([("N1", "t", ["c"], [], ["o"], 5, "S", "2023")], TRIAL), "t1", T0)
    for _ in range(2):  # a repeated run changes nothing
        counts = {r["source_name"]: r["computed"] for r in jobs.refresh_features(store, "f1", T0).collect()}
        assert counts == {"pubmed": 2, "clinicaltrials": 1}
        assert jobs.refresh_index(store, ARTICLES, IndexRun("i1"), T0).first()["indexed"] == 2
    assert jobs.refresh_index(store, TRIALS, IndexRun("i1"), T0).first()["indexed"] == 1
    assert {r["snapshot_ref"] for r in store.read("trial_stats").collect()} == {"t1"}

    later = T0 + dt.timedelta(days=1)
    store.write("curated_articles", spark.createDataFrame([("2", "c d e", "new", None, None), ("3", "f", None, None, None)], ARTICLE), "a2", later)
    jobs.refresh_features(store, "f2", later)
    stats = {r["pmid"]: (r["title_word_count"], r["snapshot_ref"], r["run_id"]) for r in store.read("article_stats").collect()}
    assert stats == {"1": (2, "a1", "f1"), "2": (3, "a2", "f2"), "3": (1, "a2", "f2")}
    assert store.read("article_stats_history").count() == 4
    assert jobs.refresh_index(store, ARTICLES, IndexRun("i2"), later).first()["indexed"] == 2
    points = {r["doc_id"]: (r["title"], r["indexing_run_id"], r["snapshot_ref"]) for r in store.read("index_articles").collect()}
    assert points == {"PMID:1": ("a b", "i1", "a1"), "PMID:2": ("c d e", "i2", "a2"), "PMID:3": ("f", "i2", "a2")}

    for run in ("i2", "i1"):  # repeated runs, also an older one, drop nothing
        jobs.refresh_index(store, ARTICLES, IndexRun(run), later)
        assert store.read("index_articles").count() == 3
