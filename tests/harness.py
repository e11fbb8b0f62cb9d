"""Compares a query with its DuckDB SQL, order-insensitive."""

import math
import os

import duckdb


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v, ".10g")
    return str(v)


def connect(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def compare(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(cell(x[i]) for i in at) for x in r.fetchall())
    assert ours == theirs
