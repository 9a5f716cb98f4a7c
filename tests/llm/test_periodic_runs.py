"""Periodic runs against a scan of all lags, with odd rows and long texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import runs


def _brute(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _words(rng):
    v = rng.choice([1, 2, 3, 5, 50])
    w = [f"w{rng.randrange(v)}" for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(3)):
        p = rng.randrange(1, 40)
        base = [f"w{rng.randrange(v)}" for _ in range(p)]
        w += [base[i % p] for i in range(rng.randrange(p * 8))] + [f"w{rng.randrange(v)}" for _ in range(rng.randrange(3))]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    rng = random.Random(seed)
    for _ in range(100):
        docs = [_words(rng) for _ in range(rng.randrange(1, 6))]
        numbers = {}
        flat = np.array([numbers.setdefault(x, len(numbers)) for d in docs for x in d], np.int64)
        got = [tuple(r) for r in runs.runs_of(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs])).tolist()]
        want, first = [], 0
        for d in docs:
            want += [(s + first, n, q) for s, n, q in _brute(d)]
            first += len(d)
        assert got == want


def test_rare_words_split_until_nothing_changes():
    # The second c and d split first; then a and b are too rare in each part.
    words = np.array([0, 1, 2, 0, 1, 0, 3, 1, 0, 1, 5, 5, 5, 5, 5, 5, 0])
    place, segment = runs.surviving_segments(words, np.zeros(len(words), np.int64))
    assert place.tolist() == [10, 11, 12, 13, 14, 15] and len(set(segment.tolist())) == 1


@pytest.mark.parametrize("n, period", [(200_000, 1), (200_000, 2), (120_000, 25_000)])
def test_long_texts(n, period):
    words = np.arange(n, dtype=np.int64) % period
    assert runs.runs_of(words, np.zeros(n, np.int64)).tolist() == [[0, n, period]]


def test_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t ", "a a a a a", "a a a a a a", "A a A a A a A a", "x " * 3 + "x\ny\x0by\x1cy", "           "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (4, "a a a a a a")] + [(100 + i, " ".join(_words(rng))) for i in range(300)]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, runs int, start string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.text, tuple(r.top) if r.top else None) for r in runs.periodic_runs(docs).withColumn("top", runs.strongest(F.col("runs"))).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        found = _brute(w)
        top = None
        for r in found:
            if top is None or r[1] * top[2] > top[1] * r[2]:
                top = r
        want.append((doc_id, found, _collapsed(w, found), top))
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_repeated_tail(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(400)] + [(None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for doc_id, text in rows:
        h, w = zlib.crc32(str(doc_id).encode()), (text or "").split()
        if doc_id is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        want.append((doc_id, text))
    assert sorted(map(tuple, runs.with_repeated_tail(docs).collect()), key=repr) == sorted(want, key=repr)
