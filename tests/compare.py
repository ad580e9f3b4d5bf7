"""Rows of a query and of its DuckDB statement, made comparable."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def views(d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(con, sql):
    r = con.execute(sql)
    return rows([c[0] for c in r.description], r.fetchall())
