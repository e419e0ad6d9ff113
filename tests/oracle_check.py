"""Spark-vs-DuckDB comparison used by the oracle tests (order-insensitive)."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, digits=6):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.asDict().items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark_df, con, sql: str, digits: int = 6):
    """Returns (ok, message). Columns compared by name; rows as a multiset."""
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    order = sorted(s_cols)
    si = [s_cols.index(n) for n in order]
    di = [d_cols.index(n) for n in order]
    sn = sorted((tuple(_norm(r[i], digits) for i in si) for r in s_rows), key=_key)
    dn = sorted((tuple(_norm(r[i], digits) for i in di) for r in d_rows), key=_key)
    if len(sn) != len(dn):
        return False, f"row counts differ: spark={len(sn)} duck={len(dn)}"
    for a, b in zip(sn, dn):
        if a != b:
            return False, f"first differing row (cols {order}):\n spark={a}\n duck ={b}"
    return True, f"{len(sn)} rows equal"
