"""Compares a query with its SQL twin on the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, (bool, int, float)):
        return (1, float(v))
    return (2, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, got.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for (p, u), (q, v) in zip(x, y):
            assert p == q and (math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6) if p == 1 else u == v), (x, y)
