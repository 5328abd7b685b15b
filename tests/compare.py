"""Side-by-side check of Spark results against DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    for t, name in (
        (int, "int"), (float, "float"), (str, "str"), (decimal.Decimal, "decimal"),
        (dt.datetime, "ts"), (dt.date, "date"),
    ):
        if isinstance(v, t):
            return name
    return type(v).__name__


def diff(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    s_cols = spark_df.columns
    if sorted(o_cols) != sorted(s_cols):
        return f"columns {sorted(s_cols)} vs {sorted(o_cols)}"
    names = sorted(s_cols)
    s_rows = [tuple(_cell(r[c]) for c in names) for r in spark_df.collect()]
    idx = [o_cols.index(c) for c in names]
    o_rows = [tuple(_cell(r[i]) for i in idx) for r in o_rows]
    if len(s_rows) != len(o_rows):
        return f"rows {len(s_rows)} vs {len(o_rows)}"
    bad, first = 0, None
    for a, b in zip(sorted(s_rows, key=_key), sorted(o_rows, key=_key)):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            bad += 1
            first = first or f"{dict(zip(names, a))}\n   vs {dict(zip(names, b))}"
    return f"{bad} rows differ, first: {first}" if bad else None
