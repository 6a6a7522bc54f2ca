"""Runs a query and its DuckDB SQL on the same tables and compares rows."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def normal(rows):
    fix = lambda v: float(v) if isinstance(v, Decimal) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = normal(tuple(r) for r in df.select(columns).collect())
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = normal(tuple(r[i] for i in order) for r in result.fetchall())
    assert columns == sorted(names)
    assert got == want
    return len(got)
