"""Runs a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list[tuple]:
    cols = sorted(frame.columns)

    def value(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return float(f"{x:.9g}") if math.isfinite(x) else str(x)
        return x if isinstance(x, int | bool | str) else str(x)

    return sorted((tuple(value(x) for x in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def by_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def differences(query, sql: str, spark, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    ours, theirs = query(spark, sf_dir).toPandas(), by_sql(sql, sf_dir)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; {only}"
