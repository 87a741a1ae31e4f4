"""Run a registered query and its oracle SQL, and compare rows as multisets."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def _clean(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found, empty when equal: columns, value kinds, rows."""
    columns = sorted(spark_df.columns)
    mine = [tuple(_clean(r[c]) for c in columns) for r in spark_df.collect()]
    rel = con.sql(sql)
    theirs_cols = sorted(rel.columns)
    if theirs_cols != columns:
        return [f"columns differ: {columns} and {theirs_cols}"]
    at = [rel.columns.index(c) for c in columns]
    theirs = [tuple(_clean(r[i]) for i in at) for r in rel.fetchall()]
    problems = []
    if len(mine) != len(theirs):
        problems.append(f"rows: {len(mine)} and {len(theirs)}")
    for i, c in enumerate(columns):
        a = {_kind(r[i]) for r in mine if r[i] is not None}
        b = {_kind(r[i]) for r in theirs if r[i] is not None}
        if a != b:
            problems.append(f"kinds of {c}: {a} and {b}")
    a, b = sorted(map(repr, mine)), sorted(map(repr, theirs))
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        problems.append(f"values {columns}: {only_a} and {only_b}")
    return problems
