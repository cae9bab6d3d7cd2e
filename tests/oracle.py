"""Comparison of a Spark result with that of SQL on the same tables."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(d):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(d):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return c


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in got), key=repr)


def same(spark, d, query, sql):
    df = query(spark, d)
    mine = rows(df.columns, df.collect())
    r = connect(d).execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert mine == rows(names, r.fetchall())
