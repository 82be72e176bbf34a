"""Runs a query and its SQL over the same tables and compares rows."""

import math
import os

import duckdb


def database(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(columns)
    out = [tuple(plain(r[columns.index(c)]) for c in order) for r in found]
    return order, sorted(out, key=lambda r: tuple("" if v is None else str(v) for v in r))


def check(spark, db, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = db.sql(sql)
    assert got == rows(relation.columns, relation.fetchall())
    return len(got[1])
