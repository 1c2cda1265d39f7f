"""Spark result against DuckDB result, as multisets of rows with columns sorted by name."""

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    left = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    right = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert len(left) == len(right), (len(left), len(right))
    for a, b in zip(left, right):
        assert a == b, (order, a, b)
    return len(left)
