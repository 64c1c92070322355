"""Rows of a Spark frame and of a DuckDB query, made comparable."""

from __future__ import annotations

import decimal
import glob
import os

import numpy as np


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal | float | int | np.number):
        return int(v) if float(v) == int(v) else round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark_df, con, sql):
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(spark_df.columns)
    want = rows(names, rel.fetchall())
    assert len(got) == len(want)
    assert got == want
