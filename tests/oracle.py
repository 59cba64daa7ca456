"""Runs a query and its SQL side by side."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(tidy(x) for x in v)
    return v


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def assert_same(spark, folder, con, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(tidy(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(tidy(r[i]) for i in at) for r in cur.fetchall())
    assert got == want
