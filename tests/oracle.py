"""Runs a query and its SQL over the same tables."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (decimal.Decimal, datetime.datetime)):
        return str(v)
    return v


def compare(spark, con, name, f, sql, folder):
    df = f(spark, folder)
    columns = sorted(df.columns)
    got = sorted((repr(plain(tuple(r[c] for c in columns))) for r in df.collect()))
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns, name
    at = [names.index(c) for c in columns]
    want = sorted(repr(plain(tuple(r[k] for k in at))) for r in cur.fetchall())
    assert got == want, (name, [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
