"""Comparison of a query with its SQL on the driver's tables."""

import datetime
import glob
import os
from collections import Counter

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def same_as_sql(spark, query, sql, sf=DATA):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    want = Counter(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert got == want


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
