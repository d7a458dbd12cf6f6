"""Compares registered queries with their DuckDB SQL: `python -m tests.oracle [folder] [names]`."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    if hasattr(x, "as_tuple"):
        return cell(float(x))
    return str(int(x)) if isinstance(x, bool) else str(x)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def differ(spark, con, folder: str, query, sql: str) -> str:
    """Empty if query and sql give the same columns and rows."""
    df = query(spark, folder)
    got, cur = rows(df.columns, df.collect()), con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    near = lambda a, b: all(x == y or _close(x, y) for x, y in zip(a, b))
    bad = [(a, b) for a, b in bad if not near(a, b)]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else ""


def _close(x: str, y: str) -> bool:
    try:
        return math.isclose(float(x), float(y), rel_tol=2e-5, abs_tol=2e-6)
    except ValueError:
        return False


def main() -> None:
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "3").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sql = tables(folder), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or [k for k in queries if not k.startswith("op") and k != "pipeline"]
    bad = 0
    for name in names:
        began = time.time()
        try:
            said = differ(spark, con, folder, queries[name], sql[name]) if name in sql else f"(rows only: {queries[name](spark, folder).count()})"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(said) and not said.startswith("(")
        print(f"{name}: {said or 'same'} {time.time() - began:.1f} s", flush=True)
    print(f"{bad} of {len(names)} differ")


if __name__ == "__main__":
    main()
