"""Runs registered queries and their SQL side by side, order-insensitively."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.6g}"
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:
    """Empty if both give the same columns and rows."""
    ours = query(spark, sf_dir).toPandas()
    theirs = connect(sf_dir).execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"]
    a, b = rows(ours), rows(theirs)
    if a == b:
        return []
    only = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return [f"{len(a)} vs {len(b)} rows; only ours: {str(only[0])[:900]}; only SQL: {str(only[1])[:900]}"]


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    from refgraph.session import local

    spark = local()
    for name in names or e.queries():
        began = time.time()
        try:
            if sql := e.oracle_sql().get(name):
                found = differences(spark, e.queries()[name], sql, sf_dir)
            else:
                found = [f"no SQL: {e.queries()[name](spark, sf_dir).count()} rows"]
        except Exception as x:  # noqa: BLE001
            found = [f"{type(x).__name__}: {str(x)[:1500]}"]
        print(f"{name}: {'ok' if not found else found[0]} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
