"""Run registered queries next to their SQL: ``python tests/compare.py [sf] [query ...]``."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("RISKLOOM_DATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir: str) -> tuple[int, list]:
    """Row count and the first rows on which both sides differ."""
    got = query(spark, sf_dir)
    left = normal_rows(got.columns, got.collect())
    want = con.sql(sql)
    right = normal_rows(want.columns, want.fetchall())
    if sorted(got.columns) != sorted(want.columns):
        return len(left), [(sorted(got.columns), sorted(want.columns))]
    if len(left) != len(right):
        return len(left), [(len(left), len(right))]
    return len(left), [(a, b) for a, b in zip(left, right, strict=True) if a != b]


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from riskloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:]
    sf_dir = f"{DATA}/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), oracle_sql()
    bad = []
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in sqls:
                rows, diff = differences(spark, con, query, sqls[name], sf_dir)
                state = "ok" if not diff else f"DIFF {len(diff)} {diff[:2]}"
            else:
                rows, diff, state = query(spark, sf_dir).count(), [], "rows only"
        except Exception as error:  # report and go on with the next query
            rows, diff, state = -1, [1], f"ERROR {str(error)[:600]}"
        if diff:
            bad.append(name)
        print(f"{name:26s} {rows:8d} rows {time.time() - start:7.2f}s  {state}", flush=True)
    print("failed:", bad or "none")


if __name__ == "__main__":
    main()
