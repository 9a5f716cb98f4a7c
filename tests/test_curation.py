import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import quality as dq
from larkspur.operators.dedup import duplicate_keys, latest_per_key, merge_newest, newest_version, upsert
from larkspur.operators.ingest import IngestRun, curate, ingest
from larkspur.operators.normalise import normalise_articles, normalise_trials, split_rejects
from larkspur.session import workspace
from larkspur.sources.readers import article_text_from_xml, conform, read_source_json, trial_text_from_json
from larkspur.sources.snapshots import UNKNOWN, SnapshotStore, create_table, latest_snapshots
from larkspur.sources.specs import ARTICLES, TRIALS, source_spec

NOW = dt.datetime(2024, 1, 1)


def article(pmid, title="T", **more):
    return {"pmid": pmid, "title": title, "abstract": "An abstract.", "authors": ["Smith JA"], "publication_date": "2024-03-15",
            "journal": "J", "source_version": "2024-01", "source_uri": "ftp://x", **more}


def trial(nct_id, **more):
    return {"nct_id": nct_id, "brief_title": "B", "conditions": ["C"], "interventions": ["I"], "primary_outcomes": ["O"],
            "sample_size": 45, "status": "RECRUITING", "start_date": "2023-06-01", "completion_date": "2026-12-31",
            "source_version": "2024-01", "source_uri": "https://x", **more}


@pytest.fixture
def deliver(spark, tmp_path):
    def write(records, spec, name="in.json"):
        path = tmp_path / name
        path.write_text(json.dumps(records), encoding="utf-8")
        return read_source_json(spark, str(path), spec)

    return write


def test_batch_split(deliver):
    records = [article(str(i)) for i in range(10)] + [article(None), article("  ")]
    good, bad = split_rejects(deliver(records, ARTICLES), ARTICLES)
    assert good.count() == 10
    assert {r["parse_error"] for r in bad.collect()} == {"Record is missing required field 'pmid'"}


def test_article_defaults(deliver):
    got = normalise_articles(deliver([{"pmid": 38000001, "publication_date": "bad"}], ARTICLES), "run", "1.0", NOW).first()
    assert (got["pmid"], got["title"], got["abstract"], got["authors"], got["publication_date"]) == ("38000001", "", None, [], None)
    assert (got["source_name"], got["source_version"], got["source_uri"], got["ingestion_run_id"]) == ("pubmed", "", "", "run")


def test_trial_sizes(deliver):
    sizes = [45, "45", "abc", None, 12.0, "12.0"]
    rows = normalise_trials(deliver([trial(f"NCT{i}", sample_size=v) for i, v in enumerate(sizes)], TRIALS), "r", "1", NOW).orderBy("nct_id").collect()
    assert [r["sample_size"] for r in rows] == [45, 45, None, None, 12, None]


def test_unknown_source():
    assert source_spec("trials") is TRIALS and source_spec("article") is ARTICLES
    with pytest.raises(ValueError, match="Unknown source_name"):
        source_spec("blogs")


def test_conform(spark):
    df = spark.createDataFrame([("NCT1", "x"), ("NCT2", "7")], "nct_id STRING, sample_size STRING")
    out = conform(df, TRIALS.raw_schema)
    assert out.columns == TRIALS.raw_schema.names
    assert [r["sample_size"] for r in out.orderBy("nct_id").collect()] == [None, 7]


def rules_broken(df, spec):
    return {(r["rule_id"], r["record_id"]) for r in dq.run_dq(df, spec).collect()}


def test_article_rules(spark):
    fields = "pmid STRING, title STRING, source_name STRING, source_version STRING, source_uri STRING, ingested_at STRING, ingestion_run_id STRING, pipeline_version STRING"
    good = ("pubmed", "v", "u", "t", "r", "1")
    rows = [("1", "T", *good), (None, "T", *good), (" ", "T", *good), ("2", " ", *good), ("3", "T", "pubmed", "", "u", None, "r", "1"), ("1", "T", *good)]
    df = spark.createDataFrame(rows, fields)
    assert rules_broken(df, ARTICLES) == {
        ("DQ-PUB-RAW-1", "unknown"), ("DQ-PUB-CUR-2", "2"), ("DQ-P1", "3"), ("DQ-PUB-CUR-1", "1")}
    message = dq.run_dq(df, ARTICLES).filter("rule_id = 'DQ-P1'").first()["message"]
    assert message == "Missing provenance fields: ['source_version', 'ingested_at']"
    results = {r["rule_id"]: r for r in dq.dq_results(df, ARTICLES).collect()}
    assert results["DQ-PUB-RAW-1"]["failed_count"] == 2 and results["DQ-PUB-CUR-1"]["failed_ids"] == ["1"]
    assert results["DQ-P1"]["outcome"] == "FAIL" and results["DQ-P1"]["record_count"] == 6


def test_empty_batch_has_no_failure(spark):
    empty = spark.createDataFrame([], ARTICLES.raw_schema)
    assert dq.any_failure(dq.dq_results(empty, ARTICLES)).first()["has_failures"] is False


def test_blank_keys_count_as_duplicates(spark):
    df = spark.createDataFrame([("",), ("",), (None,), (None,), ("a",)], "k STRING")
    assert [tuple(r) for r in duplicate_keys(df, "k").collect()] == [("", 2)]


def test_gate_blocks_and_nothing_is_published(spark, deliver):
    store = SnapshotStore(spark, workspace(spark, "gate"))
    records = deliver([article("1"), article("1"), article("2", title="")], ARTICLES)
    with pytest.raises(dq.QualityGateError) as caught:
        ingest(store, records, ARTICLES, IngestRun("r1", "1.0", NOW))
    assert "DQ-PUB-CUR-1" in str(caught.value) and "DQ-PUB-CUR-2" in str(caught.value)
    assert store.latest_snapshot_id("raw_articles") == UNKNOWN


def test_ingest_curate_rerun(spark, deliver):
    store = SnapshotStore(spark, workspace(spark, "ingest"))
    run = IngestRun("r1", "1.0", NOW, mode="quarantine")
    for _ in range(2):  # a repeated run changes nothing
        ingest(store, deliver([article("1"), article("2"), article(None)], ARTICLES), ARTICLES, run)
    ingest(store, deliver([article("2", title="new")], ARTICLES, "b.json"), ARTICLES, IngestRun("r2", "1.0", NOW + dt.timedelta(days=1)))
    curate(store, ARTICLES, "c1", NOW)
    curated = store.read("curated_articles")
    assert store.read("raw_articles").count() == 3
    assert {(r["pmid"], r["title"], r["snippet_count"]) for r in curated.collect()} == {("1", "T", 0), ("2", "new", 0)}
    assert curated.columns == ARTICLES.curated_schema.names
    reject = store.read("raw_articles_rejects").first()
    assert "pmid" in reject["parse_error"] and json.loads(reject["rejected_record"])["title"] == "T"


def test_quarantine_mode(spark, deliver):
    store = SnapshotStore(spark, workspace(spark, "quarantine"))
    delivery = deliver([article("1"), article("2", title=" "), article(None)], ARTICLES)
    results = {r["rule_id"]: r for r in ingest(store, delivery, ARTICLES, IngestRun("r", "1", NOW, mode="quarantine")).collect()}
    assert {name: (r["outcome"], r["failed_count"], r["record_count"]) for name, r in results.items()} == {
        "DQ-PUB-RAW-1": ("FAIL", 1, 3), "DQ-PUB-CUR-2": ("FAIL", 1, 3), "DQ-P1": ("PASS", 0, 3), "DQ-PUB-CUR-1": ("PASS", 0, 3)}
    violations = store.read("raw_articles_violations").collect()
    assert {(r["rule_id"], r["record_id"]) for r in violations} == {("DQ-PUB-RAW-1", "unknown"), ("DQ-PUB-CUR-2", "2")}
    assert [r["pmid"] for r in store.read("raw_articles").collect()] == ["1"]
    rejects = {(r["pmid"], r["parse_error"]) for r in store.read("raw_articles_rejects").collect()}
    assert rejects == {("2", "DQ-PUB-CUR-2"), (None, "Record is missing required field 'pmid'")}


@pytest.mark.parametrize("spec, record, rule", [(ARTICLES, article(None), "DQ-PUB-RAW-1"), (TRIALS, trial(" "), "DQ-CT-RAW-1")])
def test_missing_id_refuses_a_run(spark, deliver, spec, record, rule):
    store = SnapshotStore(spark, workspace(spark, "missing"))
    with pytest.raises(dq.QualityGateError, match=rule):
        ingest(store, deliver([record], spec), spec, IngestRun("r", "1", NOW))
    assert store.latest_snapshot_id(spec.raw_table) == UNKNOWN
    assert rule in {r["rule_id"] for r in store.read(f"{spec.raw_table}_violations").collect()}


def test_appends_at_the_same_time_are_both_kept(spark):
    root = workspace(spark, "appends")
    first, second = SnapshotStore(spark, root), SnapshotStore(spark, root)
    first.append("t", spark.range(0, 2), "a", NOW)
    second.refresh()
    first.append("t", spark.range(10, 12), "b", NOW)
    second.refresh = lambda: None  # has not seen the other's commit
    second.append("t", spark.range(20, 23), "c", NOW)
    assert sorted(r["id"] for r in SnapshotStore(spark, root).read("t").collect()) == [0, 1, 10, 11, 20, 21, 22]


def test_a_committed_snapshot_stays(spark):
    store = SnapshotStore(spark, workspace(spark, "committed"))
    store.write("t", spark.range(3), "s1", NOW)
    store.append("t", spark.range(5, 6), "s2", NOW + dt.timedelta(days=1))
    store.write("t", spark.range(7), "s1", NOW + dt.timedelta(days=2))
    assert (store.read("t", snapshot_id="s1").count(), store.read("t").count()) == (3, 4)
    store.write("t", spark.range(1), "s3", NOW + dt.timedelta(days=3))
    store.rollback("t", "s2", NOW + dt.timedelta(days=4))
    assert (store.read("t").count(), store.read("t", snapshot_id="s3").count()) == (4, 1)


def test_corrupt_lines_are_rejected(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"pmid":"1","title":"a"}\n{broken\n', encoding="utf-8")
    good, bad = split_rejects(read_source_json(spark, str(tmp_path / "x.json"), ARTICLES, lines=True), ARTICLES)
    assert [r["pmid"] for r in good.collect()] == ["1"]
    assert [r["parse_error"] for r in bad.collect()] == ["Record is no readable JSON"]


def test_dedup_ties_and_idempotence(spark):
    rows = [("a", 1, "r1", "x"), ("a", 1, "r2", "y"), ("a", 1, "r2", "y"), ("b", 2, "r1", "z")]
    df = spark.createDataFrame(rows, "k STRING, ingested_at INT, ingestion_run_id STRING, v STRING")
    once = newest_version(df, "k")
    assert {(r["k"], r["v"]) for r in once.collect()} == {("a", "y"), ("b", "z")}
    assert sorted(map(tuple, newest_version(once, "k").collect())) == sorted(map(tuple, once.collect()))
    split = merge_newest(newest_version(df.filter("v = 'x'"), "k"), df.filter("v <> 'x'"), "k")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, once.collect()))


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = latest_per_key(df, ["k"], [F.desc("v")], [])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id INT, v STRING, n INT")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id INT, v STRING, n INT")
    once = upsert(old, new, "id", [F.desc("n")])
    want = [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upsert(once, new, "id", [F.desc("n")]).collect())) == want


def test_snapshots(spark):
    store = SnapshotStore(spark, workspace(spark, "snap"))
    assert store.latest_snapshot_id("t") == UNKNOWN
    day = [NOW + dt.timedelta(days=i) for i in range(5)]
    store.write("t", spark.range(1), "a", day[0])
    store.append("t", spark.range(10, 12), "b", day[1])
    store.stage("t", spark.range(99), "half")  # never published, never seen
    assert store.read("t").count() == 3 and store.read("t", as_of=day[0]).count() == 1
    store.rollback("t", "a", day[2])
    assert store.latest_snapshot_id("t") == "a" and store.read("t").count() == 1
    assert store.read("t", snapshot_id="b").count() == 3
    assert [r["snapshot_id"] for r in latest_snapshots(store.log()).collect()] == ["a"]
    assert [(r["column_name"], r["data_type"]) for r in store.list_datasets().collect()] == [("id", "bigint")]
    with pytest.raises(ValueError):
        store.read("t", as_of=NOW - dt.timedelta(days=1))


def test_create_table(spark):
    create_table(spark, "lark_test_db.raw_articles", ARTICLES.raw_schema, "ingestion_run_id")
    create_table(spark, "lark_test_db.raw_articles", ARTICLES.raw_schema, "ingestion_run_id")
    assert set(spark.table("lark_test_db.raw_articles").columns) == set(ARTICLES.raw_schema.names)
    spark.sql("DROP DATABASE lark_test_db CASCADE")


def test_staged_texts(spark):
    xml = "<Abstract><AbstractText>One</AbstractText><AbstractText></AbstractText><AbstractText>Two</AbstractText></Abstract>"
    rows = [("1", xml), ("x1", xml), ("2", "<Abstract>broken"), ("3", "<Abstract></Abstract>"), ("4", "<Abstract><AbstractText>Solo</AbstractText></Abstract>")]
    df = spark.createDataFrame(rows, "id STRING, xml STRING")
    got = [r[0] for r in df.orderBy("id").select(article_text_from_xml(F.col("id"), F.col("xml"))).collect()]
    assert got == ["One\n\nTwo", None, None, "Solo", None]
    both = '{"protocolSection":{"descriptionModule":{"briefSummary":"S","detailedDescription":"D"}}}'
    short = '{"protocolSection":{"descriptionModule":{"briefSummary":"S","detailedDescription":""}}}'
    df = spark.createDataFrame([("NCT1", both), ("NCT2", short), ("X", both), ("NCT3", "{}"), ("NCT4", "{bad")], "id STRING, j STRING")
    assert [r[0] for r in df.orderBy("id").select(trial_text_from_json(F.col("id"), F.col("j"))).collect()] == ["D", "S", None, None, None]


def test_orphans_and_missing(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "fk INT")
    parent = spark.createDataFrame([(1,)], "id INT")
    assert sorted(r["fk"] or 0 for r in dq.orphan_rows(child, parent, "fk", "id").collect()) == [0, 2, 2]
    got = dq.null_counts(spark.createDataFrame([("a", None), (" ", "x")], "a STRING, b STRING"), ["a", "b"]).collect()
    assert {(r["column_name"], r["missing"]) for r in got} == {("a", 1), ("b", 1)}


def test_registry_rule(spark):
    df = spark.createDataFrame([("f1", "bigint", "words", "0"), ("f2", "bigint", None, "0"), ("f3", "string", None, None)], "field STRING, data_type STRING, units STRING, null_rule STRING")
    got = dq.row_violations(df, dq.registry_rules(), F.col("field")).collect()
    assert [(r["record_id"], r["message"]) for r in got] == [("f2", "Missing registry fields: ['units']")]
