"""Runs a query and its SQL twin and compares rows without regard to order."""

import math

import duckdb

from keysnap.queries.fixtures import TABLES


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def oracle_rows(sf, sql):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    return normal([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])
