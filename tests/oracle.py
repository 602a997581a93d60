"""Compares a query's rows with those of its SQL on the same tables."""

import os
from collections import Counter

import duckdb


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return round(v, 6)
    return v


def same(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
