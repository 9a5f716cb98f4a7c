"""The SQL of the decontamination query against the query, on documents shorter than an item."""

import random

import duckdb

from larkspur.llm import queries


def test_short_documents(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((40, 25, 12, 59))]
    texts = [t for _, t in items]
    cut = [" ".join(t.split()[k : len(t.split()) - j]) for t in texts for k, j in ((0, 2), (3, 0), (1, 1), (0, 9))]
    inside = [" ".join(rng.choice(words) for _ in range(30)) + " " + t + " " + " ".join(rng.choice(words) for _ in range(30)) for t in texts]
    docs = [(i, t) for i, t in enumerate([*texts, *cut, *inside, "w1 w2", "", None, *(" ".join(rng.choice(words) for _ in range(50)) for _ in range(20))])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted((d, i, s, n, round(x, 9)) for d, i, s, n, x in con.execute(queries.ORACLES["op10_decontamination"]).fetchall())
    got = sorted((r.doc_id, r.item_id, r.start, r.n_shingles, round(r.similarity, 9)) for r in queries.QUERIES["op10_decontamination"](spark, str(tmp_path)).collect())
    assert got == want and len(got) >= 16 and any(d >= 4 and n < len(texts[i].split()) - 4 for d, i, _, n, _ in got)
