"""Compare registered queries with their DuckDB checks: ``python check.py [sf] [name ...]``."""

from __future__ import annotations

import datetime as dt
import importlib
import math
import sys
import time

import duckdb

from larkspur.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


# DuckDB type name of each Spark type in use.
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got_rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS  {name}: {len(got_rows)} rows {took:.1f}s")
                continue
            start = time.time()
            want = con.execute(oracles[name])
            columns, kinds = [d[0] for d in want.description], {d[0]: str(d[1]) for d in want.description}
            got, expected = _rows(df.columns, got_rows), _rows(columns, want.fetchall())
            sql_took = time.time() - start
            types = [(f.name, f.dataType.simpleString(), kinds.get(f.name)) for f in df.schema.fields if KINDS.get(f.dataType.simpleString()) != kinds.get(f.name)]
            if sorted(df.columns) != sorted(columns):
                bad += 1
                print(f"FAIL  {name}: columns {sorted(df.columns)} vs {sorted(columns)}")
            elif got != expected:
                bad += 1
                diff = [(a, b) for a, b in zip(got, expected) if a != b][:2]
                print(f"FAIL  {name}: {len(got)} vs {len(expected)} rows; {sorted(columns)}")
                for a, b in diff:
                    print("   spark", str(a)[:700], "\n   sql  ", str(b)[:700])
            else:
                print(f"OK    {name}: {len(got)} rows {took:.1f}s (sql {sql_took:.1f}s)" + (f" TYPES {types}" if types else ""))
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:900]}")
    print("failed:", bad)


if __name__ == "__main__":
    main()
