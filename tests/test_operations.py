import datetime as dt
import json
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import metrics as mt
from larkspur.operators import reports as rp
from larkspur.operators.lake import Lake
from larkspur.operators.visits import step_times
from larkspur.session import workspace
from larkspur.plans import curation, operations
from larkspur.plans.data import trials
from larkspur.sources.specs import ARTICLES
from larkspur.sources.tables import KeyedTable
from larkspur.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def log(spark):
    rows = [(T0, "approved", 0.4, None), (T0 + dt.timedelta(minutes=4), "rejected", 12.0, None), (T0 + dt.timedelta(minutes=5), "approved", 200.0, "DQ-UI-1"),
            (T0 + dt.timedelta(minutes=6), "blocked", 3.0, "DQ-UI-1"), (T0 + dt.timedelta(minutes=6), "error", 3.0, "DQ-UI-2")]
    return spark.createDataFrame(rows, "ts TIMESTAMP, status STRING, duration_s DOUBLE, rule STRING")


def test_success_ratio(log):
    got = {r["window_start"]: (r["total"], r["approved"], r["success_ratio"]) for r in mt.success_ratio(log).collect()}
    assert got == {T0: (2, 1, 0.5), T0 + dt.timedelta(minutes=5): (2, 1, 0.5)}
    with_blocked = {r["total"] for r in mt.success_ratio(log, count_blocked=True).collect()}
    assert with_blocked == {2, 3}


def test_latency_interpolation(spark):
    df = spark.createDataFrame([(0.3,), (0.4,), (7.0,), (8.0,), (500.0,)], "duration_s DOUBLE")
    got = {r["probability"]: r["latency_s"] for r in mt.latency_quantiles(df, [0.2, 0.4, 0.6, 0.95]).collect()}
    assert got == pytest.approx({0.2: 0.25, 0.4: 0.5, 0.6: 7.5, 0.95: 120.0})


def test_rates_and_status(log):
    assert {(r["rule"], r["n"]) for r in mt.violation_rate(log).collect()} == {("DQ-UI-1", 2), ("DQ-UI-2", 1)}
    assert {r["rule"]: r["violations"] for r in mt.violation_totals(log).collect()} == {"DQ-UI-1": 2, "DQ-UI-2": 1}
    assert {r["metric"]: r["band"] for r in mt.slo_status(log).collect()} == {"success_ratio": "red", "p95_latency_s": "red", "dq_violations": "yellow"}
    assert mt.total_queries(log).first()[0] == 5


def test_load_acceptance(spark):
    good = spark.createDataFrame([(200, 1)] * 19 + [(502, 0)], "http_status INT, citations INT")
    p95 = spark.createDataFrame([(29.0,)], "quantile DOUBLE")
    assert tuple(mt.load_acceptance(good, p95).first()) == (20, 0.95, 29.0, True)
    assert mt.load_acceptance(good, spark.createDataFrame([(31.0,)], "quantile DOUBLE")).first()["accepted"] is False


def test_distributions(spark):
    docs = spark.createDataFrame([("en",), ("en",), ("fr",)], "lang STRING")
    assert {(r["lang"], round(r["share"], 2), r["high_foreign_share"]) for r in mt.language_distribution(docs, limit=0.3).collect()} == {("en", 0.67, True), ("fr", 0.33, True)}
    trials = spark.createDataFrame([("r1", "A"), ("r1", "B"), ("r2", "A")], "run STRING, status STRING")
    got = {(r["run"], r["status"]): (r["change"], r["spike"]) for r in mt.status_distribution(trials).collect()}
    assert got == {("r1", "A"): (None, False), ("r1", "B"): (None, False), ("r2", "A"): (0.5, True)}


def test_recent_queries(spark):
    df = spark.range(300).select(F.col("id"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("ts"))
    rows = rp.recent_queries(df, "id", "ts").orderBy("position").collect()
    assert (len(rows), rows[0]["query_id"], rows[-1]["query_id"], rows[-1]["display_no"], rows[0]["display_no"]) == (200, 100, 299, 1, None)


def write_batches(spark, batches, schema, folder, fmt="parquet"):
    """One file per batch, in reading order."""
    import os
    import time

    for i, rows in enumerate(batches):
        path = f"{folder}/in/b{i}"
        getattr(spark.createDataFrame(rows, schema).coalesce(1).write, fmt)(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def test_stream_slo_drops_late_rows_and_equals_batch(spark, tmp_path):
    schema = "ts TIMESTAMP, status STRING"
    on_time = [[(at(1), "approved"), (at(2), "rejected")], [(at(30), "approved")], [(at(31), "blocked"), (at(60), "error")]]
    late = [(at(3), "approved")]
    stream = write_batches(spark, [*on_time, late], schema, tmp_path).parquet(str(tmp_path / "in"))
    jobs.stream_slo(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = mt.success_ratio(spark.createDataFrame([r for b in on_time for r in b], schema))
    assert got == {tuple(r) for r in batch.filter(F.col("window_start") < F.lit(at(45))).collect()} and len(got) == 2


def line(q, node="cmo_router", n=0):
    return 'data: {"node": "%s", "query_id": "%s", "elapsed_ms": %d}' % (node, q, n)


def test_stream_events_over_batches(spark, tmp_path):
    """Visits that the watermark closed, over batches out of order; the open one stays in the state."""
    batches = [[(line("a"), at(1)), ("data: {bad", at(0))], [(line("a"), at(5)), (line("b"), at(2))], [(line("a"), at(0))], [(line("a"), at(50)), (line("c"), at(90))]]
    stream = write_batches(spark, batches, "line STRING, ts TIMESTAMP", tmp_path).parquet(str(tmp_path / "in"))
    jobs.stream_step_events(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 3, at(0), at(5), 300000), ("b", 1, at(2), at(2), 0), ("a", 1, at(50), at(50), 0)}


def test_stream_step_times_equal_batch_and_leave_no_state(spark, tmp_path):
    """Steps out of order within the watermark, ties, a late step, an idle query and a restart from the checkpoint."""
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    first = [[(line("a", "x", 2), at(1)), (line("a", "w", 1), at(1)), ("data: {bad", at(0)), ('data: {"node": "n"}', at(0))], [(line("a", "y"), at(0)), (line("b"), at(2))]]
    second = [[(line("a", "z"), at(8)), (line("c"), at(60))], [(line("a", "again"), at(100))], [(line("a", "late"), at(3)), (line("d"), at(101))], [(line("z"), at(300))]]
    for turn, batches in enumerate((first, second)):
        write_batches(spark, batches, "line STRING, ts TIMESTAMP", f"{tmp_path}/in{turn}")
    (tmp_path / "in").mkdir()
    for turn in (0, 1):
        for i in range(len((first, second)[turn])):
            for f in (tmp_path / f"in{turn}" / "in" / f"b{i}").glob("part-*"):
                shutil.copy2(f, f"{folder}/{turn}-{i}-{f.name}")
        stream = spark.readStream.schema("line STRING, ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(folder)
        query = state.stream_step_times(stream, out, str(tmp_path / "cp"), "10 minutes")
        query.awaitTermination()
    rows = [r for b in first + second for r in b if '"late"' not in r[0]]
    batch = step_times(state.step_events(spark.createDataFrame(rows, "line STRING, ts TIMESTAMP")), 1_800_000)
    want = {tuple(r) for r in batch.filter(F.col("ts") <= F.lit(at(290))).collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want and len(want) == 8
    # Only the last query, which the watermark has not passed, still has state.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_stream_uniqueness_over_batches(spark, tmp_path):
    batches = [[("1", at(0)), (" 2", at(1)), (None, at(1)), ("", at(1))], [("2", at(2)), ("3", at(2))], [("", at(3))] * 50, [("2 ", at(4)), ("9", at(2000))], [("1", at(2001))], [("8", at(9000))]]
    stream = write_batches(spark, batches, "pmid STRING, at TIMESTAMP", tmp_path).parquet(str(tmp_path / "in"))
    query = state.stream_uniqueness(stream, ARTICLES, "at", str(tmp_path / "out"), str(tmp_path / "cp"), "1 minute", idle_ms=24 * 3_600_000)
    query.awaitTermination()
    found = state.uniqueness_violations(spark.read.parquet(str(tmp_path / "out")), ARTICLES).collect()
    # The second 1 comes after its first was forgotten.
    assert {(r["record_id"], r["copies"], r["rule_id"]) for r in found} == {("2", 3, "DQ-PUB-CUR-1"), ("", 51, "DQ-PUB-CUR-1")}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_stream_ingest_restart_adds_only_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lake = Lake(spark, workspace(spark, "stream"))

    def deliver(name, records):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")
        stream = spark.readStream.schema(ARTICLES.input_schema()).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        jobs.stream_ingest(stream, lake, ARTICLES, "1", T0, str(tmp_path / "cp"), "stream").awaitTermination()

    base = {"source_version": "v", "source_uri": "u"}
    deliver("a.json", [{"pmid": "1", "title": "A", **base}, {"pmid": " ", "title": "x", **base}])
    deliver("b.json", [{"pmid": "2", "title": "", **base}, {"pmid": "1", "title": "B", **base}])
    assert sorted((r["pmid"], r["title"], r["ingestion_run_id"]) for r in lake.raw(ARTICLES).read().collect()) == [("1", "A", "stream-0"), ("1", "B", "stream-1")]
    assert sorted(r["parse_error"] for r in lake.rejects(ARTICLES).read().collect()) == ["DQ-PUB-CUR-2", "Record is missing required field 'pmid'"]


def test_stream_curate_equals_batch(spark, tmp_path):
    schema = "k STRING, ingested_at TIMESTAMP, ingestion_run_id STRING, v INT"
    batches = [[("a", at(5), "r1", 1), ("a", at(1), "r1", 2)], [("a", at(2), "r2", 3), ("b", at(1), "r2", 4)], [("b", at(1), "r3", 5)]]
    stream = write_batches(spark, batches, schema, tmp_path).parquet(str(tmp_path / "in"))
    curated = KeyedTable(spark, workspace(spark, "curate"), "k", ["ingested_at", "ingestion_run_id", "v"], 4)
    for _ in range(2):  # the second start finds nothing new
        jobs.stream_curate(stream, curated, str(tmp_path / "cp")).awaitTermination()
        assert sorted((r["k"], r["v"]) for r in curated.read().collect()) == [("a", 1), ("b", 5)]


class _Value:
    """A state of one key that counts its reads."""

    def __init__(self, value=None):
        self.value, self.reads = value, 0

    def exists(self):
        self.reads += 1
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value if self.value is not None or not isinstance(self, _List) else []

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, more):
        self.value = [*(self.value or []), *more]

    def clear(self):
        self.value = None


class _List(_Value):
    pass


class _Handle:
    """Timers as the stream keeps them."""

    def __init__(self):
        self.timers = set()

    def registerTimer(self, due):
        self.timers.add(due)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_query_sets_one_timer_not_one_per_step():
    job = state.StepTimes(1000)
    job.handle, job.waiting, job.done = _Handle(), _List(), _Value()
    ts = pd.Series([pd.Timestamp(x, unit="ms") for x in (30, 10, 20, 40, 10)])
    assert list(job.handleInputRows(("a",), iter([pd.DataFrame({"ts": ts, "position": range(5), "node": list("cabdz")})]), _Watermark(0))) == []
    assert job.handle.timers == {10}
    job.handle.timers.clear()
    (out,) = job.handleExpiredTimer(("a",), _Watermark(25), None)
    assert list(zip(out["step_no"], out["node"], out["elapsed_ms"], out["step_ms"])) == [(1, "a", 0, 0), (2, "z", 0, 0), (3, "b", 10, 10)]
    # The next step that waits, and the end of the visit.
    assert job.handle.timers == {30, 20 + 1000 + 1}
    (out,) = job.handleExpiredTimer(("a",), _Watermark(40), None)
    assert out["node"].tolist() == ["c", "d"] and job.waiting.value is None


def test_repeated_keys_read_their_state_once():
    job = state.RepeatedKeys(1000)
    job.handle, job.seen = _Handle(), _Value()
    one = pd.DataFrame({"n": [1], "first_ts": [pd.Timestamp(5, unit="ms")], "last_ts": [pd.Timestamp(5, unit="ms")]})
    assert list(job.handleInputRows(("a",), iter([one]), None)) == [] and job.seen.reads == 1
    (out,) = job.handleInputRows(("a",), iter([one]), None)
    assert out["copies"].tolist() == [2] and job.seen.reads == 2


def _documents_in_files(spark, folder, files):
    rows = [(i, f"Title {i}\nbody \"{i}\" [{{", ["en", "de", "fr", "es"][i % 4], f"src{i % 9}", 20 + i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    docs.repartition(files).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_deliveries_have_as_many_files_as_the_table_has_splits(spark, tmp_path, monkeypatch, request):
    """JSON arrays and streamed lines: a task writes and reads its part only; the stream takes three batches all the same."""
    sf_dir = _documents_in_files(spark, tmp_path / "in", 7)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(200 << 20))
    request.addfinalizer(lambda: spark.conf.set("spark.sql.files.openCostInBytes", before))
    splits = spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions()
    assert splits == 7
    monkeypatch.setattr(curation, "workspace", lambda spark, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(operations, "workspace", lambda spark, purpose: str(tmp_path / purpose))
    assert curation.q_read_arrays(spark, sf_dir).count() == 60
    assert len(list((tmp_path / "arrays" / "in").glob("part-*"))) == splits
    assert operations.q_stream_ingest(spark, sf_dir).count() == 60
    base = tmp_path / "stream-ingest"
    assert len(list((base / "in").glob("part-*"))) == splits
    assert len([f for f in (base / "checkpoint" / "commits").iterdir() if f.name.isdigit()]) == 3


def test_lines_meet_by_order_before_they_get_texts(spark, tmp_path):
    """Trials: the texts of parts that are sent to all tasks are not shuffled; results as ever, also for orders without lines."""
    day = dt.date(2024, 1, 1)
    data = {
        "part": spark.createDataFrame([(1, "B", "y"), (2, "A", "x"), (2, "A", "x")], "p_partkey long, p_type string, p_name string"),
        "lineitem": spark.createDataFrame(
            [(7, 1, 2.0, "R", day), (7, 2, 3.0, "N", None), (7, 9, 5.0, "N", day), (None, 1, 1.0, "A", day)],
            "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_shipdate date"),
        "orders": spark.createDataFrame([(7, "O", "1-URGENT", day), (8, "F", "2-HIGH", day)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate date"),
    }
    for name, rows in data.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    made = trials(spark, str(tmp_path))
    got = {r["nct_id"][-1]: (r["conditions"], r["interventions"], r["primary_outcomes"], r["sample_size"], r["completion_date"]) for r in made.collect()}
    assert got == {"7": (["A", "B"], ["x", "y"], ["N", "R"], 8, "2024-01"), "8": (None, None, None, None, None)}
    plan = trials(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin [l_partkey") < plan.index("Exchange hashpartitioning(l_orderkey")
    assert "collect_set" not in plan[plan.index("Exchange hashpartitioning(l_orderkey"):]
