"""Runs registered queries in Spark and their SQL twins in DuckDB and compares the two results.

    python -m tests.oracle /root/testdata/sf0.01 [name-substring ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(dtype.kind, "text")


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return int(value) if value.is_integer() else float(f"{value:.9g}")
    return value


def _rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted((tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=repr)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """An empty string when both results agree, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    for name in spark_frame.columns:
        a, b = spark_frame[name], sql_frame[name]
        if _kind(a.dtype) != _kind(b.dtype) and a.notna().all() and b.notna().all() and len(a):
            return f"type of {name}: {a.dtype} != {b.dtype}"
    mine, theirs = _rows(spark_frame), _rows(sql_frame)
    for left, right in zip(mine, theirs):
        if left != right:
            return f"{sorted(spark_frame.columns)}\n   spark {left}\n   sql   {right}"
    return ""


def run(spark, folder: str, names=None):
    """Yields (name, problem, spark seconds, rows, checked)."""
    import __spark_entry__ as entry

    con = connect(folder)
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        started = time.time()
        try:
            df = fn(spark, folder)
            got = df.toPandas()
            problem = compare(got, con.execute(sql[name]).df()) if name in sql else ""
        except Exception as exc:  # report every query, not only the first failure
            yield name, f"{type(exc).__name__}: {str(exc)[:1500]}", time.time() - started, 0, name in sql
            continue
        yield name, problem, time.time() - started, len(got), name in sql


def main() -> int:
    from codestrata.session import build_session

    spark = build_session(spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, problem, seconds, rows, checked in run(spark, sys.argv[1], sys.argv[2:]):
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {seconds:6.2f}s {rows:8d} rows {'' if checked else '(no SQL twin)'}", flush=True)
        if problem:
            print("     " + problem, flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(main())
