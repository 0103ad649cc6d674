"""Runs a query and its SQL text side by side and compares rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(v: object) -> str:
    return (
        "null" if v is None
        else "bool" if isinstance(v, bool)
        else "int" if isinstance(v, int)
        else "float" if isinstance(v, float)
        else type(v).__name__
    )


def plain(v: object) -> object:
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, row count, values and kinds of values agree."""
    got_cols = list(spark_df.columns)
    got = rows_of(got_cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    out = []
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns differ: {sorted(set(got_cols) ^ set(want_cols))}"]
    if len(got) != len(want):
        out.append(f"rows: {len(got)} against {len(want)}")
    names = sorted(got_cols)
    for a, b in zip(got, want):
        if a != b or [kind(x) for x in a] != [kind(x) for x in b]:
            bad = [
                (names[i], x, y)
                for i, (x, y) in enumerate(zip(a, b))
                if x != y or kind(x) != kind(y)
            ]
            out.append(f"first difference: {bad[:4]}")
            break
    return out
