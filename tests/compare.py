"""Run a query and its oracle SQL side by side and compare their values."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v + 0.0, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    a = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = canon([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {set(a[0]) ^ set(b[0])}"
    if a[1] == b[1]:
        return None
    only_a, only_b = set(a[1]) - set(b[1]), set(b[1]) - set(a[1])
    return f"rows {len(a[1])} / {len(b[1])}; spark only {len(only_a)} {sorted(only_a)[:2]}; oracle only {len(only_b)} {sorted(only_b)[:2]} cols {a[0]}"
