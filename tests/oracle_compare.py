"""Side-by-side comparison of a Spark report with its DuckDB oracle.

Mirrors the correctness gate: same row count, same column names, and the same
multiset of rows (compared as sorted tuples of normalized values).
"""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return ("",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", round(v, 6))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v)) if abs(v) < 2**53 else ("i", v)
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return ("t", v.isoformat())
    return ("s", str(v))


def normalized_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, name: str, spark_fn, sql: str, sf_dir: str, con=None) -> dict:
    df = spark_fn(spark, sf_dir)
    s_rows = df.collect()
    s_cols = df.columns
    con = con or duck_connection(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "spark_columns": s_cols,
        "oracle_columns": d_cols,
    }
    if out["columns_match"]:
        a = normalized_rows(s_cols, s_rows)
        b = normalized_rows(d_cols, d_rows)
        out["values_match"] = a == b
        if a != b:
            sa, sb = set(a), set(b)
            out["only_spark"] = sorted(sa - sb)[:3]
            out["only_oracle"] = sorted(sb - sa)[:3]
    else:
        out["values_match"] = False
    out["ok"] = out["values_match"] and out["spark_rows"] == out["oracle_rows"]
    return out
