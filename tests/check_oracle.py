"""Runs every registered query beside its SQL and compares columns, types and values.

    python tests/check_oracle.py [folder] [name prefix]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from corpusloom.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.astype(object).where(df.notna(), None).map(
        lambda v: "null" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)
    )
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = canonical(left), canonical(right)
    if not a.equals(b):
        where = (a != b).any(axis=1)
        return f"values differ in {where.sum()} rows:\n{a[where].head(3).to_string()}\n{b[where].head(3).to_string()}"
    if kinds(left) != kinds(right):
        diff = {c: (k, kinds(right)[c]) for c, k in kinds(left).items() if k != kinds(right)[c]}
        return f"ok, but types {diff}"
    return "ok"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefix = sys.argv[2] if len(sys.argv) > 2 else ""
    spark, con = local_session(8), connect(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if not name.startswith(prefix):
            continue
        start = time.time()
        try:
            left = run(spark, folder).toPandas()
            spent = time.time() - start
            if name in sql:
                start = time.time()
                result = compare(left, con.execute(sql[name]).df())
                result += f" (sql {time.time() - start:.1f}s)"
            else:
                result = "no sql"
        except Exception as error:  # noqa: BLE001
            left, spent, result = [], time.time() - start, f"ERROR {str(error)[:1500]}"
        bad += not result.startswith(("ok (", "no sql"))
        print(f"{name:36s} {len(left):8d} rows {spent:6.1f}s  {result}", flush=True)
    print(f"{bad} not ok")
    return bad


if __name__ == "__main__":
    raise SystemExit(main() > 0)
