"""Compare a Spark DataFrame with a DuckDB query on the same Parquet tables.

Rows are compared order-insensitively after a light normalisation (decimals and
floats rounded to 6 places, dates as ISO text, nested values as JSON text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math

import duckdb

RAW = ("region nation customer supplier part orders lineitem events documents "
       "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return json.dumps([_norm(x) for x in v], default=str)
    if isinstance(v, dict):
        return json.dumps({str(k): _norm(x) for k, x in v.items()}, default=str, sort_keys=True)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark_df, con, sql: str):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    info = {"spark_rows": len(s_rows), "duck_rows": len(d_rows)}
    if sorted(s_cols) != sorted(d_cols):
        info["error"] = f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return False, info
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        info["error"] = f"values differ; first diffs: {diff}"
        return False, info
    return True, info
