"""Rows of a query and of its SQL, in a form that can be compared."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(names)
    return order, sorted(repr([plain(r[names.index(n)]) for n in order]) for r in got.fetchall())
