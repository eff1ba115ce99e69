"""Compare registered queries with their SQL twins: columns, row count, every value.

Run as a script: ``python tests/oracle_check.py <data folder> [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    """One spelling per value; -0.0 is 0.0 and a missing number is None."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    result = con.execute(sql)
    want_columns, want = normal_rows([d[0] for d in result.description], result.fetchall())
    got_columns, got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if sum(got.values()) != sum(want.values()):
        return f"rows {sum(got.values())} != {sum(want.values())}"
    if got != want:
        extra, missing = got - want, want - got
        return f"{sum(extra.values())} rows differ: got {sorted(extra, key=str)[:2]} want {sorted(missing, key=str)[:2]}"
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from latelens.session import local_session

    spark = local_session()
    con = connect(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = compare(df, con, sql[name]) if name in sql else f"no twin, {df.count()} rows"
        except Exception as e:  # keep going: the list of failures is the point
            problem = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad = problem is not None and not problem.startswith("no twin")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:30s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
