"""Compares a query with its SQL on DuckDB."""

import math
import os

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return list(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, f, sql, sf: str = DATA):
    df = f(spark, sf)
    found = connect(sf).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, found.fetchall())
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
    return len(got)
