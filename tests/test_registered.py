import __spark_entry__ as entry
import pytest


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "evidence" in df.columns


@pytest.mark.parametrize("name", ["normalise_articles", "dq_report_articles", "features_as_of", "vector_topk", "latency_quantiles"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "documents orders lineitem part events embeddings benchmark pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    result = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(result, key=repr)
