"""Order-insensitive comparison of a Spark DataFrame with a DuckDB query on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, "" if x is None else str(type(x).__name__), "" if x is None else x) for x in row)


def compare(df, con, sql: str, max_show: int = 5) -> dict:
    sp_cols = df.columns
    rel = con.execute(sql)
    dk_cols = [d[0] for d in rel.description]
    dk_rows = rel.fetchall()
    sp_rows = [tuple(r) for r in df.collect()]
    res = {"spark_rows": len(sp_rows), "oracle_rows": len(dk_rows),
           "spark_cols": sp_cols, "oracle_cols": dk_cols}
    if sorted(sp_cols) != sorted(dk_cols):
        res["ok"] = False
        res["why"] = "columns differ"
        return res
    order = sorted(sp_cols)
    si = [sp_cols.index(c) for c in order]
    di = [dk_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in sp_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in dk_rows), key=_key)
    res["ok"] = a == b
    if not res["ok"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [dict(zip(order, r)) for r in list(sa - sb)[:max_show]]
        res["only_oracle"] = [dict(zip(order, r)) for r in list(sb - sa)[:max_show]]
    return res


def pandas_rows(pdf) -> list[str]:
    """Rows of a pandas frame as text, columns in name order, NULL/NaN as one token —
    the view a hash over ``toPandas()`` / DuckDB ``.df()`` output would take."""
    import numpy as np
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "<null>"
        return str(v)

    return sorted("|".join(cell(v) for v in r) for r in pdf.itertuples(index=False))
