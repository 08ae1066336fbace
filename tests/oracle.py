"""Run a query and its SQL twin side by side."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(query, sql, spark, con, sf_dir):
    """(problem or None, number of rows, seconds in Spark)."""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    left = rows_of(df.columns, got)
    if sql is None:
        return None, len(got), took
    result = con.execute(sql)
    right = rows_of([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", len(got), took
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}", len(got), took
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return (f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None), len(got), took


def main() -> None:
    from runlens.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), oracle_sql()
    failed = 0
    for name, q in queries().items():
        if chosen and name not in chosen:
            continue
        try:
            problem, n, took = compare(q, sqls.get(name), spark, con, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        failed += problem is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:32s} {n:8d} {took:6.2f}s {problem or ''}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
