"""Run tables, key tables and the deliveries that are merged into them."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from larkspur.operators import quality as dq
from larkspur.operators.index import IndexRun
from larkspur.operators.ingest import IngestRun
from larkspur.operators.lake import Lake, curate_runs, index_changes, ingest_run
from larkspur.session import workspace, written
from larkspur.sources import tables
from larkspur.sources.specs import ARTICLES
from larkspur.sources.tables import BUCKET, KeyedTable, RunTable

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k STRING, n INT, v STRING"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def keyed(spark):
    return KeyedTable(spark, workspace(spark, "keyed"), "k", ["n"], 8)


def files(path):
    path = path.removeprefix("file:")
    return {(folder, name): os.stat(f"{folder}/{name}").st_mtime_ns for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, keyed):
    keyed.upsert(spark.createDataFrame([(f"k{i}", 1, "old") for i in range(200)], SCHEMA))
    before = files(keyed.path)
    changed = keyed.upsert(spark.createDataFrame([("k3", 2, "new"), ("k3", 1, "lost"), ("k7", 0, "too old"), ("fresh", 0, "x")], SCHEMA))
    assert rows(changed) == [("fresh", 0, "x"), ("k3", 2, "new")]
    touched = {r[0] for r in spark.createDataFrame([("k3",), ("k7",), ("fresh",)], "k STRING").select(keyed._bucket()).collect()}
    kept = {f: t for f, t in before.items() if int(f[0].rsplit(f"{BUCKET}=", 1)[1]) not in touched}
    assert len(kept) >= 5 and kept.items() <= files(keyed.path).items()
    want = {f"k{i}": (1, "old") for i in range(200)} | {"k3": (2, "new"), "fresh": (0, "x")}
    assert {r["k"]: (r["n"], r["v"]) for r in keyed.read().collect()} == want
    plan = keyed.read(sorted(touched))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" + BUCKET in plan.replace("PartitionFilters: [isnotnull(" + BUCKET, "PartitionFilters: [" + BUCKET)


def test_upserts_are_idempotent_and_order_does_not_matter(spark, keyed):
    parts = [spark.createDataFrame(x, SCHEMA) for x in ([("a", 2, "b"), ("b", 1, "x")], [("a", 1, "c"), (None, 1, "null key")], [("a", 3, "d"), ("c", None, "null order")])]
    for turn in (parts, parts[::-1]):
        for part in turn:
            keyed.upsert(part)
    assert rows(keyed.read()) == sorted([("a", 3, "d"), ("b", 1, "x"), ("c", None, "null order")], key=repr)
    assert keyed.upsert(parts[0].limit(0)).count() == 0 and keyed.read().count() == 3


def test_an_upsert_stores_its_change_set_once(spark, keyed, monkeypatch):
    """Rows are wide; of the comparison with old rows only keys are stored, and rows known to be unique are not shuffled by key."""
    keyed.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], SCHEMA))
    stored = []
    monkeypatch.setattr(tables, "written", lambda df, purpose: stored.append(df) or written(df, purpose))
    changed = keyed.upsert(spark.createDataFrame([("a", 2, "y"), ("b", 4, "y"), ("c", 0, "y"), (None, 9, "y")], SCHEMA), unique=True)
    assert [df.columns for df in stored] == [["k", "n", "v", BUCKET], ["k"]]
    assert "Window" not in stored[0]._jdf.queryExecution().executedPlan().toString()
    assert rows(changed) == [("a", 2, "y"), ("c", 0, "y")] and rows(keyed.read()) == [("a", 2, "y"), ("b", 5, "x"), ("c", 0, "y")]


def test_hot_key_and_nothing_yet(spark, keyed):
    with pytest.raises(ValueError):
        keyed.read()
    for _ in range(2):
        keyed.upsert(spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("n"), F.lit("v").alias("v")))
    assert rows(keyed.read()) == [("hot", 4999, "v")]


def test_runs_replace_themselves(spark):
    runs = RunTable(spark, workspace(spark, "runs"), spark.createDataFrame([], "a INT, ingestion_run_id STRING").schema)
    assert runs.read().count() == 0

    def run(name, *values):
        runs.write(spark.createDataFrame([(v, name) for v in values], runs.schema), name)

    run("007", 1, 2)
    run("r2", 3)
    run("007", 5)
    assert rows(runs.read()) == [(3, "r2"), (5, "007")] and rows(runs.read(["r2"])) == [(3, "r2")]
    run("007")
    assert rows(runs.read()) == [(3, "r2")]
    with pytest.raises(ValueError):
        run("../x", 1)


def articles(spark, *records):
    schema = ARTICLES.input_schema()
    return spark.createDataFrame([{"source_version": "v", "source_uri": "u", **r} for r in records], schema)


def test_deliveries(spark):
    """Rule results counted once per run, a refused run that is mended, runs curated out of order, an index of what changed."""
    lake = Lake(spark, workspace(spark, "lake"), 4)
    bad = articles(spark, {"pmid": "1", "title": "A"}, {"pmid": "1", "title": "A"}, {"pmid": " ", "title": "x"}, {"pmid": "2", "title": ""})
    with pytest.raises(dq.QualityGateError) as refused:
        ingest_run(lake, bad, ARTICLES, IngestRun("r1", "1", T0))
    assert "DQ-PUB-CUR-1" in str(refused.value) and lake.raw(ARTICLES).read().count() == 0
    assert {(r["rule_id"], r["record_id"]) for r in lake.violations(ARTICLES).read(["r1"]).collect()} == {("DQ-PUB-CUR-1", "1"), ("DQ-PUB-RAW-1", "unknown"), ("DQ-PUB-CUR-2", "2")}
    results = ingest_run(lake, bad, ARTICLES, IngestRun("r2", "1", T0, mode="quarantine"))
    plain = dq.dq_results(lake.raw(ARTICLES).read(), ARTICLES)
    assert results.columns == plain.columns
    got = {r["rule_id"]: (r["outcome"], r["failed_count"], r["record_count"], r["failed_ids"]) for r in results.collect()}
    assert got == {"DQ-PUB-RAW-1": ("FAIL", 1, 4, ["unknown"]), "DQ-PUB-CUR-2": ("FAIL", 1, 4, ["2"]), "DQ-P1": ("PASS", 0, 4, []), "DQ-PUB-CUR-1": ("FAIL", 1, 4, ["1"])}
    ingest_run(lake, articles(spark, {"pmid": "1", "title": "A2"}, {"pmid": "3", "title": "C"}), ARTICLES, IngestRun("r1", "1", T0 + dt.timedelta(days=1)))
    assert lake.violations(ARTICLES).read(["r1"]).count() == 0

    late = curate_runs(lake, ARTICLES, ["r1"], T0)
    index_changes(lake, ARTICLES, late, "s1", IndexRun("i1"), T0)
    early = curate_runs(lake, ARTICLES, ["r2"], T0)
    assert early.count() == 0  # its only good key has a newer version
    assert index_changes(lake, ARTICLES, early, "s2", IndexRun("i2"), T0).count() == 0
    assert {(r["pmid"], r["title"]) for r in lake.curated(ARTICLES).read().collect()} == {("1", "A2"), ("3", "C")}
    assert lake.curated(ARTICLES).read().columns == ARTICLES.curated_schema.names
    assert {(r["doc_id"], r["title"], r["indexing_run_id"]) for r in lake.index(ARTICLES).read().collect()} == {("PMID:1", "A2", "i1"), ("PMID:3", "C", "i1")}


def test_sampled_ids_of_a_hot_id(spark):
    df = spark.range(20_000).select(F.lit("r").alias("g"), F.when(F.col("id") % 10 < 9, F.lit("unknown")).otherwise(F.col("id").cast("string")).alias("id"))
    plan = dq.sample_ids(df, ["g"], "id", 3)
    assert plan.first()["failed_ids"] == sorted({"unknown", *(str(i) for i in range(20_000) if i % 10 == 9)})[:3]
