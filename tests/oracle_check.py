"""Compare a Spark query with its DuckDB oracle the way the driver does: same row count,
same column names, and equal order-insensitive multisets of normalised values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tidemark.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = rel.fetchall()
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(df, con, sql):
    sc, srows = rows_of_spark(df)
    dc, drows = rows_of_duck(con, sql)
    problems = []
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
    if len(srows) != len(drows):
        problems.append(f"row count differs: spark={len(srows)} duck={len(drows)}")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s_sorted, d_sorted = sorted(srows, key=key), sorted(drows, key=key)
    if not problems and s_sorted != d_sorted:
        diff_s = [r for r in s_sorted if r not in set(d_sorted)][:5]
        diff_d = [r for r in d_sorted if r not in set(s_sorted)][:5]
        problems.append(f"values differ; spark-only={diff_s} duck-only={diff_d}")
    return problems, len(srows)
