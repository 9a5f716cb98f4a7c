import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import vectors as vx
from larkspur.functions.vectors import cosine, embed, l2_norm, l2_normalise
from larkspur.operators import index as ix
from larkspur.operators import search as sx
from larkspur.operators.search import SearchColumns, cluster_vectors, fill_content, merge_topk, scored_shares, search, vector_topk
from larkspur.sources.specs import TRIALS

DAY = dt.date(2020, 1, 1)
FILTERED = SearchColumns(equal=(("source_type", "want"),), dates=("date_from", "date_to", "ask_from", "ask_to"))


@pytest.fixture(scope="module")
def corpus(spark):
    """Vectors of which a third are copies of one, and questions with all kinds of filters."""
    rnd = random.Random(11)
    copy = [rnd.gauss(0, 1) for _ in range(8)]
    docs = []
    for i in range(240):
        vector = copy if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(8)]
        start = DAY + dt.timedelta(days=rnd.randrange(1000))
        dates = (None, None) if i % 10 == 0 else (start, start + dt.timedelta(days=30))
        docs.append((f"d{i:03d}", [0.0] * 8 if i == 5 else None if i == 7 else vector, rnd.choice(["article", "trial"]), *dates))
    asked = []
    for i in range(14):
        lo = DAY + dt.timedelta(days=400) if i % 3 == 0 else None
        hi = DAY + dt.timedelta(days=700) if i % 4 == 0 else None
        asked.append((i, copy if i == 2 else [rnd.gauss(0, 1) for _ in range(8)], rnd.choice(["article", "trial", None, "nowhere"]), lo, hi))
    vectors = spark.createDataFrame(docs, "doc_id STRING, vector ARRAY<FLOAT>, source_type STRING, date_from DATE, date_to DATE").repartition(5)
    questions = spark.createDataFrame(asked, "query_id INT, query_vector ARRAY<FLOAT>, want STRING, ask_from DATE, ask_to DATE")
    return docs, asked, vectors, questions


def brute(docs, asked, k):
    out = {}
    for q, qv, want, lo, hi in asked:
        hits = []
        for d, v, kind, first, last in docs:
            if v is None or (want is not None and kind != want):
                continue
            if (lo is not None and not (last is not None and last >= lo)) or (hi is not None and not (first is not None and first <= hi)):
                continue
            a, b = np.float32(qv).astype(float), np.float32(v).astype(float)
            length = np.linalg.norm(a) * np.linalg.norm(b)
            hits.append((-(round(float(a @ b / length), 6) if length else 0.0), d))
        out[q] = [(d, -s) for s, d in sorted(hits)[:k]]
    return {q: h for q, h in out.items() if h}


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("k", [1, 7, 500])
def test_topk_matches_brute_force(corpus, k):
    docs, asked, vectors, questions = corpus
    want = brute(docs, asked, k)
    assert as_lists(vector_topk(vectors, questions, k, FILTERED)) == want
    assert as_lists(vector_topk(vectors, questions, k, FILTERED, centers=6, slice_rows=20, batch_questions=3)) == want


def test_own_limits_and_collections(corpus, spark):
    """Limits 0, 1, 3, 5 and none, and one, two, no or unknown collections, mixed in one batch."""
    docs, asked, vectors, _ = corpus
    limits, lists = [3, None, 5, 1, 0, 300], [["article"], None, [], ["trial", "article"], ["nowhere"], ["trial"]]
    rows = [(q, v, limits[q % 6], lists[(q + q // 6) % 6]) for q, v, *_ in asked]
    questions = spark.createDataFrame(rows, "query_id INT, query_vector ARRAY<FLOAT>, own INT, sets ARRAY<STRING>")
    names = SearchColumns(within=(("source_type", "sets"),), limit="own")
    want = {}
    for q, v, own, sets in rows:
        kept = [d for d in docs if not sets or d[2] in sets]
        want |= brute(kept, [(q, v, None, None, None)], 4 if own is None else own)
    for options in ({}, {"centers": 4, "slice_rows": 25, "batch_questions": 2}):
        assert as_lists(vector_topk(vectors, questions, 4, names, **options)) == want


def test_cells_are_ruled_out(spark):
    """On grouped vectors few are scored, and the hits are those of all pairs; copies and zero vectors included."""
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(30, 16))
    docs = [(f"d{i:04d}", (groups[i % 30] + 0.02 * rng.normal(size=16)).tolist(), None, None, None) for i in range(1500)]
    docs += [(f"e{i:04d}", groups[0].tolist(), None, None, None) for i in range(700)] + [("z0", [0.0] * 16, None, None, None)]
    asked = [(i, (groups[i] + 0.02 * rng.normal(size=16)).tolist(), None, None, None) for i in range(12)] + [(99, [0.0] * 16, None, None, None)]
    vectors = spark.createDataFrame([d[:2] for d in docs], "doc_id STRING, vector ARRAY<FLOAT>").repartition(6)
    questions = spark.createDataFrame([a[:2] for a in asked], "query_id INT, query_vector ARRAY<FLOAT>")
    clustered = cluster_vectors(vectors, slice_rows=100)
    assert as_lists(search(clustered, questions, 5)) == brute(docs, asked, 5)
    shares = {r["query_id"]: r["scored_share"] for r in scored_shares(clustered, questions, 5).collect()}
    assert shares[99] == 1.0 and max(s for q, s in shares.items() if q not in (0, 99)) < 0.2
    # The cell of the 700 copies is cut into slices.
    most = clustered.rows.groupBy("_cell", "_slice").count().agg(F.max("count")).first()[0]
    assert clustered.cells.agg(F.max("_rows")).first()[0] >= 700 and most < 200


def test_no_vectors_or_no_questions(corpus):
    _, _, vectors, questions = corpus
    assert vector_topk(vectors.limit(0), questions, 3, FILTERED).count() == 0
    assert vector_topk(vectors, questions.limit(0), 3, FILTERED).count() == 0


def test_merge_of_collections_is_the_global_best(corpus):
    docs, asked, vectors, questions = corpus
    parts = [vector_topk(vectors.filter(f"source_type = '{t}'"), questions, 6, FILTERED) for t in ("article", "trial")]
    merged = {q: [s for _, s in h] for q, h in as_lists(merge_topk(parts, 6)).items()}
    assert merged == {q: [s for _, s in h] for q, h in brute(docs, asked, 6).items()}


def test_merge_ties_keep_collection_order(spark):
    a = spark.createDataFrame([(1, "z", 0.5, 1)], "query_id INT, doc_id STRING, score DOUBLE, rank INT")
    b = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.9, 2)], "query_id INT, doc_id STRING, score DOUBLE, rank INT")
    assert [r["doc_id"] for r in merge_topk([a, b], 2).orderBy("rank").collect()] == ["b", "z"]


def test_empty_inputs(corpus):
    _, _, vectors, questions = corpus
    assert vector_topk(vectors.limit(0), questions, 3, FILTERED).count() == 0
    assert vector_topk(vectors, questions.limit(0), 3, FILTERED).count() == 0


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = df.select(l2_norm("a"), l2_normalise("a"), cosine("a", "b")).collect()
    assert got[0][0] == 5.0 and got[0][1] == pytest.approx([0.6, 0.8]) and got[0][2] == pytest.approx(0.96)
    assert list(got[1]) == [0.0, [0.0, 0.0], 0.0]


def test_encoder_is_a_parameter(spark):
    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abcd"), (2, ""), (3, None)], "i INT, t STRING").repartition(2)
    rows = {r["i"]: r["v"] for r in df.select("i", embed("t", lengths, batch_size=1).alias("v")).collect()}
    assert rows[1] == pytest.approx([4 / 17**0.5, 1 / 17**0.5]) and rows[2] == [0.0, 1.0] and rows[3] == [0.0, 1.0]
    assert df.limit(0).select(embed("t", lengths)).count() == 0
    hashed = df.select("i", embed("t").alias("v")).orderBy("i").collect()
    assert len(hashed[0]["v"]) == 64 and sum(x * x for x in hashed[0]["v"]) == pytest.approx(1.0) and set(hashed[1]["v"]) == {0.0}


def test_index_trials(spark):
    df = spark.createDataFrame([("NCT1", "Title", ["a", "b"], [], "2023-06")], "nct_id STRING, brief_title STRING, conditions ARRAY<STRING>, interventions ARRAY<STRING>, start_date STRING")
    r = ix.index_rows(df, TRIALS, "snap", ix.IndexRun("run")).first()
    assert (r["doc_id"], r["content"], r["snippet"], r["source_type"], r["snapshot_ref"]) == ("NCT:NCT1", "a, b", "a, b", "trial", "snap")
    assert (str(r["date_from"]), str(r["date_to"]), len(r["vector"])) == ("2023-06-01", "2023-06-30", 64)


def test_fill_content(spark):
    rows = [("1", "", "s", "article"), ("2", "Abstract B", "s", "article"), ("3", "real text", "s", "article"), ("4", None, "s", "trial"), ("5", "", "s", "article")]
    hits = spark.createDataFrame(rows, "doc_id STRING, content STRING, snippet STRING, source_type STRING")
    staged = spark.createDataFrame([("1", "F1"), ("2", "F2"), ("3", "F3"), ("5", "")], "doc_id STRING, page STRING")
    got = {r["doc_id"]: r["content"] for r in fill_content(hits, staged, F.col("page")).collect()}
    assert got == {"1": "F1", "2": "F2", "3": "real text", "4": "s", "5": "s"}
    assert {r["content"] for r in fill_content(hits).collect()} == {"s", "Abstract B", "real text"}


def test_few_questions_go_to_the_vectors(spark, corpus, monkeypatch):
    """The hits of a shuffle by cell, in rank order and with own limits, but no vector is shuffled."""
    docs, asked, vectors, questions = corpus
    names = SearchColumns(equal=FILTERED.equal, dates=FILTERED.dates, limit="own")
    own = questions.withColumn("own", F.element_at(F.array(F.lit(1), F.lit(None).cast("int"), F.lit(0), F.lit(40)), (F.col("query_id") % 4 + 1).cast("int")))
    cells = cluster_vectors(vectors, names, centers=6)
    want = sorted(map(tuple, search(cells, own, 7, sent_questions=0).collect()))
    monkeypatch.setattr(sx, "_scored", None)
    monkeypatch.setattr(sx, "SCORE_BLOCK", 300)
    assert len(want) > 50 and sorted(map(tuple, search(cells, own, 7).collect())) == want
    assert search(cells, own.limit(0), 7).count() == 0
    none = cluster_vectors(vectors.limit(0), names)
    assert search(none, own, 7).count() == 0


def test_cells_without_some_documents(spark, corpus):
    """Cells are reused for a part of their vectors; the bounds of the whole still hold."""
    docs, asked, vectors, questions = corpus
    gone = spark.createDataFrame([(f"d{i:03d}",) for i in range(0, 240, 2)] + [("unknown",), (None,)], "doc_id STRING")
    cells = cluster_vectors(vectors, FILTERED, centers=6).without(gone)
    assert as_lists(search(cells, questions, 5)) == brute([d for d in docs if int(d[0][1:]) % 2], asked, 5)


def test_a_word_is_hashed_once_per_process(monkeypatch):
    seen = []
    monkeypatch.setattr(vx, "_slot", lambda token: seen.append(token) or 3)
    texts = ["Zyxwv zyxwv qqzzq", "", "qqzzq"]
    for _ in range(2):
        assert vx.hash_encoder(texts)[:, 3].tolist() == [3, 0, 1] and vx.hash_encoder([]).shape == (0, vx.HASH_DIM)
    assert seen == ["zyxwv", "qqzzq"]
