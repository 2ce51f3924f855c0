"""Compare registered queries with their SQL on the shared test data.

Usage: python tests/oracle_check.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """None when equal, else a description of the first difference."""
    got = fn(spark, folder)
    mine = rows_of(got.columns, got.collect())
    if sql is None:
        return None if mine else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"columns differ: {sorted(got.columns)} / {sorted(names)}"
    theirs = rows_of(names, cur.fetchall())
    if mine == theirs:
        return None if mine else "both empty"
    extra = [r for r in mine if r not in set(theirs)][:2]
    lost = [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} rows / {len(theirs)} rows; {sorted(names)}\n   only ours {extra}\n   only SQL {lost}"


def main() -> int:
    from eventflow.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picked = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if picked and not any(p in name for p in picked):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, folder, fn, oracles.get(name))
        except Exception as error:
            diff = f"{type(error).__name__}: {str(error)[:400]}"
        bad += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        note = "" if name in oracles else " (rows only)"
        print(f"{mark} {name} {time.time() - start:.2f}s{note}" + (f"\n   {diff}" if diff else ""), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
