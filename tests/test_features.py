import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions.text import PUNCTUATION
from larkspur.operators import entities as en
from larkspur.operators import features as ft
from larkspur.operators.asof import as_of_join, in_blocks, timeline_steps
from larkspur.operators.quantiles import exact_quantiles

T0 = dt.datetime(2024, 1, 1)


def test_article_stats(spark):
    rows = [("1", "Deep learning in clinical trials today", "One two three four five six seven.", "2024-01-10", "J", "s"),
            ("2", None, "   ", "not-a-date", None, None)]
    df = spark.createDataFrame(rows, "pmid STRING, title STRING, abstract STRING, publication_date STRING, journal STRING, snapshot_ref STRING")
    assert [tuple(r) for r in ft.article_stats(df).orderBy("pmid").collect()] == [("1", 6, 7, 2024, 1, "J", "s"), ("2", 0, 0, 0, 0, "", "")]


def test_trial_stats_text_and_arrays(spark):
    text = spark.createDataFrame([("N1", 120, "outcome", "DONE", "a, b, c", "s"), ("N2", None, " ", None, "", None)],
                                 "nct_id STRING, sample_size INT, primary_outcomes STRING, status STRING, conditions STRING, snapshot_ref STRING")
    assert [tuple(r) for r in ft.trial_stats(text).orderBy("nct_id").collect()] == [("N1", 120, 1, "DONE", 3, "s"), ("N2", 0, 0, "", 0, "")]
    lists = spark.createDataFrame([("N1", 1, ["o"], "S", ["a, b", "c"], "s"), ("N2", 1, [], "S", [], "s")],
                                  "nct_id STRING, sample_size INT, primary_outcomes ARRAY<STRING>, status STRING, conditions ARRAY<STRING>, snapshot_ref STRING")
    assert [(r["has_outcomes"], r["condition_count"]) for r in ft.trial_stats(lists).orderBy("nct_id").collect()] == [(1, 2), (0, 0)]


def test_materialise_window(spark):
    rows = [("a", T0 - dt.timedelta(days=730), 1), ("a", T0 - dt.timedelta(days=1), 2), ("b", T0, 3), ("b", T0 + dt.timedelta(days=1), 4), ("c", T0 - dt.timedelta(days=730), 5)]
    df = spark.createDataFrame(rows, "pmid STRING, event_timestamp TIMESTAMP, v INT")
    assert sorted((r["pmid"], r["v"]) for r in ft.materialise_features(df, "pmid", T0).collect()) == [("a", 2), ("b", 3)]


def test_lookup_keeps_duplicates_and_drops_unknown(spark):
    features = spark.createDataFrame([("1", 5), ("2", None)], "pmid STRING, title_word_count INT")
    keys = spark.createDataFrame([(0, "1"), (1, "9"), (2, "1"), (3, "2")], "position INT, pmid STRING")
    got = ft.feature_lookup(keys, features, "pmid", "title_word_count").orderBy("position").collect()
    assert [(r["position"], r["title_word_count"]) for r in got] == [(0, 5), (2, 5)]


@pytest.mark.parametrize("blocks, ttl", [(None, None), (2, 1), (9, None), (9, 1)])
def test_as_of_matches_brute_force_with_a_hot_key(spark, blocks, ttl):
    rnd = random.Random(7)
    key = lambda: "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(8)}"
    at = lambda: T0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 6))
    history = [(key(), at(), i) for i in range(300)]
    asks = [(i, key(), at()) for i in range(300)] + [(300 + i, k, t) for i, (k, t, _) in enumerate(history[:20])]
    asks.append((999, "hot", T0 + dt.timedelta(days=30)))
    got = as_of_join(
        spark.createDataFrame(asks, "q INT, k STRING, ts TIMESTAMP"), spark.createDataFrame(history, "k STRING, event_timestamp TIMESTAMP, v INT"),
        "k", "ts", "event_timestamp", ["v"], ttl, "v", blocks,
    )
    want = {}
    for q, k, t in asks:
        seen = [(ts, v) for kk, ts, v in history if kk == k and ts <= t and (ttl is None or ts > t - dt.timedelta(days=ttl))]
        want[q] = max(seen) if seen else (None, None)
    assert {r["q"]: (r["valid_from"], r["v"]) for r in got.collect()} == want


def test_hot_moment_is_spread_over_blocks(spark):
    """Nine of ten rows have one key and one day, half of all one moment: blocks stay even and the result is right."""
    moment = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 86_400)
    events = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.timestamp_seconds(F.lit(1_700_000_000) + moment).alias("ts"), F.col("id").alias("n"),
    )
    sizes = [r["count"] for r in in_blocks(events, ["k", "ts", "n"], 8).groupBy("_block").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 8 and max(sizes) < 5000
    got = {r["n"]: (r["elapsed_ms"], r["step_ms"]) for r in timeline_steps(events, "k", "ts", "n", 8).collect()}
    w = Window.partitionBy("k").orderBy("ts", "n")
    seconds = F.unix_seconds("ts")
    plain = events.select("n", ((seconds - F.first(seconds).over(w)) * 1000).alias("e"), ((seconds - F.coalesce(F.lag(seconds).over(w), seconds)) * 1000).alias("s"))
    assert got == {r["n"]: (r["e"], r["s"]) for r in plain.collect()}
    history = events.select("k", F.col("ts").alias("at"), F.col("n").alias("v"))
    asks = events.filter("n % 7 = 0").select("k", "ts", "n")
    found = {r["n"]: r["v"] for r in as_of_join(asks, history, "k", "ts", "at", ["v"], tie_break="v", blocks=8).collect()}
    newest = Window.partitionBy("k").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    best = events.withColumn("v", F.max(F.struct("ts", "n")).over(newest)["n"]).filter("n % 7 = 0")
    assert found == {r["n"]: r["v"] for r in best.collect()}


def test_quantiles_of_a_hot_range(spark):
    """Nearly all values lie in a tiny range, without any group: rounds cut it until few values are ordered together."""
    df = spark.range(30_000).select(F.when(F.col("id") % 100 > 0, F.col("id") * 1e-9 + 5).otherwise(F.col("id") * 1.0).alias("v"))
    got = {r["probability"]: r["quantile"] for r in exact_quantiles(df, [], "v", [0.01, 0.5, 0.999], 200).collect()}
    values = np.array([i * 1e-9 + 5 if i % 100 else i * 1.0 for i in range(30_000)])
    assert got == pytest.approx({p: np.quantile(values, p) for p in got}, abs=1e-12) and len(got) == 3
    assert exact_quantiles(df.limit(0), [], "v", [0.5], 200).count() == 0


def test_staleness(spark):
    rows = [("articles", "s1", T0), ("articles", "s2", T0), ("trials", "s1", T0 - dt.timedelta(hours=25))]
    features = spark.createDataFrame(rows, "table_name STRING, snapshot_ref STRING, event_timestamp TIMESTAMP")
    current = spark.createDataFrame([("articles", "s2"), ("trials", "s1")], "table_name STRING, snapshot_id STRING")
    got = {(r["table_name"], r["snapshot_ref"]): (r["snapshot_outdated"], r["too_old"]) for r in ft.feature_staleness(features, current, F.lit(T0)).collect()}
    assert got == {("articles", "s1"): (True, False), ("articles", "s2"): (False, False), ("trials", "s1"): (False, True)}


@pytest.mark.parametrize("most", [1, 20, 10**6])
def test_quantiles_match_numpy(spark, most):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(5)}", rnd.choice([rnd.gauss(0, 30), 7.0, -2.5])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {(r["g"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0], most).collect()}
    groups = {g: [v for k, v in rows if k == g and v is not None] for g, _ in rows}
    want = {(g, p): np.quantile(vs, p) for g, vs in groups.items() if vs for p in (0.0, 0.25, 0.5, 0.99, 1.0)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("blocks", [None, 1, 3, 7])
def test_timeline(spark, blocks):
    rows = [("q", 0, T0), ("q", 1, T0 + dt.timedelta(milliseconds=1500)), ("q", 2, T0 + dt.timedelta(hours=2)), ("r", 0, T0), ("q", 3, T0 + dt.timedelta(hours=2))]
    got = timeline_steps(spark.createDataFrame(rows, "k STRING, n INT, ts TIMESTAMP"), "k", "ts", "n", blocks)
    assert {(r["k"], r["n"]): (r["elapsed_ms"], r["step_ms"]) for r in got.collect()} == {
        ("q", 0): (0, 0), ("q", 1): (1500, 1500), ("q", 2): (7200000, 7198500), ("q", 3): (7200000, 0), ("r", 0): (0, 0)}


def test_outcomes_leave_unknown_out(spark):
    df = spark.createDataFrame([("a", 10.0, True), ("a", None, False), ("a", 20.0, True)], "g STRING, v DOUBLE, ok BOOLEAN")
    r = ft.outcome_summary(df, ["g"], "v", F.col("ok")).first()
    assert (r["outcomes"], r["known"], r["mean_value"], round(r["success_rate"], 3)) == (3, 2, 15.0, 0.667)


TEXTS = [(1, "Aspirin, ünder  test.\n\nMetformin and aspirin"), (2, "nothing here"), (3, "METFORMIN aspirin"), (4, "METFORMIN aspirin"), (5, None)]


TERMS = ["aspirin", "metformin", "unused", "test", "aspirin under", "ünder test metformin x", "metformin and", "and aspirin"]


def mentions(spark, texts=TEXTS, terms=TERMS):
    docs = spark.createDataFrame([(i, "trial" if i == 4 else "article", t) for i, t in texts], "doc_id INT, source_type STRING, text STRING")
    return en.entity_mentions(en.sections(docs), spark.createDataFrame([(t,) for t in terms], "term STRING"), keep=("doc_id", "source_type"))


def plain_mentions(texts, terms):
    """Leftmost longest matches, word by word."""
    out = []
    for doc_id, text in texts:
        start = 0
        for no, section in enumerate((text or "").split("\n")):
            words, at = [], start
            for word_no, piece in enumerate(re.split(r"\s", section)):
                bare = piece.lower().strip(PUNCTUATION)
                if bare:
                    words.append((bare, word_no, at))
                at += len(piece) + 1
            i = 0
            while i < len(words):
                n = max((n for n in range(1, 6) if " ".join(w for w, _, _ in words[i : i + n]) in terms and i + n <= len(words)), default=0)
                if n:
                    out.append((doc_id, no, " ".join(w for w, _, _ in words[i : i + n]), *words[i][1:]))
                i += max(n, 1)
            start += len(section) + 1
    return sorted(out)


def test_mentions_have_true_offsets(spark):
    rows = mentions(spark).collect()
    texts = dict(TEXTS)
    assert {(r["doc_id"], r["section_no"], r["term"], r["word_no"]) for r in rows} == {
        (1, 0, "aspirin", 0), (1, 0, "test", 3), (1, 2, "metformin and", 0), (1, 2, "aspirin", 2), (3, 0, "metformin", 0), (3, 0, "aspirin", 1),
        (4, 0, "metformin", 0), (4, 0, "aspirin", 1)}
    for r in rows:
        assert texts[r["doc_id"]][r["mention_start"]:].lower().startswith(r["term"])


def test_phrases_by_brute_force(spark):
    """Overlapping phrases of one to five words, prefixes that are no terms, punctuation, blanks in a row, a long section, empty texts."""
    rnd = random.Random(4)
    vocabulary = ["a", "B", "c,", "(d)", "e.", "-", "", "ä", "?!"]
    texts = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(30))) + ("\n" if i % 3 else "\t") + " ".join(rnd.choice(vocabulary) for _ in range(10))) for i in range(120)]
    texts += [(900, None), (901, ""), (902, "a b " * 4000)]
    terms = {"a", "a b", "a b c", "b c d e a", "c d", "d e a b c", "ä -", "e e", "b c d", "b a b a b", "a b a b a"}
    found = mentions(spark, texts, [*terms, "", "a b"])
    assert sorted((r["doc_id"], r["section_no"], r["term"], r["word_no"], r["mention_start"]) for r in found.collect()) == plain_mentions(texts, terms)
    assert mentions(spark, texts, ["zzz"]).count() == 0 and mentions(spark, TEXTS[:1]).limit(0).count() == 0


def test_counts_and_pairs(spark):
    found = mentions(spark)
    assert {r["term"]: (r["mentions"], r["publications"], r["trials"]) for r in en.entity_counts(found).collect()} == {
        "aspirin": (4, 2, 1), "metformin": (2, 1, 1), "metformin and": (1, 1, 0), "test": (1, 1, 0)}
    want = {("aspirin", "metformin"): (1, 1), ("aspirin", "metformin and"): (1, 0), ("aspirin", "test"): (1, 0), ("metformin and", "test"): (1, 0)}
    for block in (256, 2, 1):
        assert {(r["term_a"], r["term_b"]): (r["publications"], r["trials"]) for r in en.cooccurrence(found, block).collect()} == want


def test_a_document_with_very_many_terms_is_spread(spark):
    """All pairs of one document's 600 terms, made by many tasks from bounded rows."""
    rows = spark.range(600).select(F.lit(1).alias("doc_id"), F.lit("article").alias("source_type"), F.format_string("t%05d", "id").alias("term"))
    pairs = en.cooccurrence(rows.unionByName(rows.withColumns({"doc_id": F.lit(2), "source_type": F.lit("trial")})), 32)
    r = pairs.agg(F.count("*").alias("n"), F.min("publications").alias("p"), F.max("trials").alias("t")).first()
    assert tuple(r) == (600 * 599 // 2, 1, 1)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [term_a") < plan.index("RepartitionByExpression")


def test_registry(spark):
    got = ft.feature_registry(spark)
    assert got.count() == 11 and got.filter("data_type = 'bigint' AND units IS NULL").count() == 0 and got.select("ttl_days").distinct().first()[0] == 365


def test_pairs_are_added_up_before_they_are_rows(spark):
    """Many documents that share their terms: as many rows leave the counting tasks as there are pairs, not pairs of each document."""
    numbers = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "article").when(F.col("id") % 3 == 1, "trial").alias("source_type"))
    rows = numbers.select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("no")).filter("pmod(hash(doc_id, no), 4) > 0")
    rows = rows.select("doc_id", "source_type", F.format_string("t%03d", "no").alias("term"))
    a, b = rows.alias("a"), rows.alias("b")
    same = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.term") < F.col("b.term")))
    kinds = [F.count_if(F.col("a.source_type") == t).alias(c) for c, t in en.KINDS.items()]
    want = sorted(map(tuple, same.groupBy(F.col("a.term").alias("x"), F.col("b.term").alias("y")).agg(*kinds).collect()))
    for step, block in ((1 << 20, 1024), (50, 16)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(en, "PAIR_STEP", step)
            assert sorted(map(tuple, en.cooccurrence(rows, block).collect())) == want
    pairs = en.cooccurrence(rows)
    counted = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert len(counted) == 2 and "_counted_pairs" in counted[0]


def test_words_that_begin_no_term_are_no_rows(spark):
    """The words listed are those that may begin a term; the words behind them travel with those alone that begin a longer one."""
    docs = spark.createDataFrame([(1, "One two, three x one\n\nnone of them two"), (2, None)], "doc_id INT, text STRING")
    maps = en.first_words(en.term_prefixes(spark.createDataFrame([("one two three",), ("two",)], "term STRING")))
    rows = en.section_words(en.sections(docs), 4, ["doc_id"], maps).orderBy("section_no", "at").collect()
    assert [(r["section_no"], r["at"], r["word"], r["following"], r["word_no"], r["mention_start"]) for r in rows] == [
        (0, 0, "one", ["two", "three", "x", "one"], 0, 0), (0, 1, "two", [], 1, 4), (0, 4, "one", [], 4, 17), (2, 3, "two", [], 3, 35)]


def test_leftmost_matches_over_batches_and_null_keys():
    """The kept matches do not depend on how the sorted rows are cut; null is a section of its own."""
    import pyarrow as pa

    rows = [(None, 0, 0, 3), (None, 0, 2, 1), (None, 0, 3, 1), ("a", None, 0, 1), ("a", 0, 0, 2), ("a", 0, 0, 1), ("a", 0, 1, 1), ("a", 1, 1, 1), ("b", 1, 1, 1)]
    names, kinds = ["doc", "section", "at", "n"], [pa.string(), pa.int32(), pa.int32(), pa.int32()]
    whole = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
    for cut in (1, 2, 3, 9):
        kept = [tuple(r.values()) for b in en._leftmost(2)(whole.slice(i, cut) for i in range(0, 9, cut)) for r in b.to_pylist()]
        assert kept == [rows[i] for i in (0, 2, 3, 4, 7, 8)]
