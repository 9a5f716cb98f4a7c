"""Line dedup against a plain loop, with odd rows and a hot line."""

import random
from collections import defaultdict

import pytest

from larkspur.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def _key(line):
    return line.strip(BLANKS).encode().lower().decode()


def _expected(rows, least_documents=2, least_length=10):
    holders = defaultdict(set)
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                holders[_key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [doc_id is not None and len(_key(x)) >= least_length and len(holders[_key(x)]) >= least_documents and doc_id > min(holders[_key(x)]) for x in lines]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [
    (1, None), (2, ""), (3, "\n\n"), (4, "a shared line here\nown line of four\n"), (5, " \tA Shared LINE here \r\nshort\nshort"), (6, "short\nÄ Shared line here\nä shared line here"),
    (7, "ä shared line here\nown line of seven"), (7, "own line of seven\nother own line"), (7, "own line of seven\nother own line"), (8, "own line of seven"), (None, "a shared line here"), (None, None),
    (9, "x  padded line  "), (10, "padded line \nninechars\nninechars"), (11, "ninechars\nten chars!\nten chars!"), (12, "ten chars!"),
]


def test_lines_by_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, lines string, h1 int")
    assert _got(linededup.without_repeated_lines(docs)) == _expected(ROWS)


@pytest.mark.parametrize("least_documents", [2, 4])
def test_random_lines(spark, least_documents):
    rng = random.Random(least_documents)
    pool = [f"{rng.choice(['Line', 'line', ' LINE'])} number {rng.randrange(40)}" for _ in range(60)] + ["", "tiny", "x" * 10]
    rows = [(rng.randrange(90), "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(linededup.without_repeated_lines(docs, least_documents)) == _expected(rows, least_documents)


def test_hot_line_goes_through_no_shuffle_of_its_rows(spark):
    rows = [(i, "a line that all documents hold\nown line " + str(i)) for i in range(3000)] + [(5000, "x" * 200_000 + "\n" + "\n".join(f"long {i % 7000} line" for i in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = linededup.line_hashes(docs)
    shared = linededup.shared_lines(lines)
    assert [(r.first_id, r.n_rows) for r in shared.collect()] == [(0, 3000)]
    # One key of 23,000 rows exceeds a part and is broadcast.
    assert shared.filter(f"n_rows > {23_000 // linededup.PARTS}").count() == 1
    assert _got(linededup.without_repeated_lines(docs)) == _expected(rows)


def test_empty_table(spark):
    assert linededup.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
