"""Runs a query and its SQL on one folder and compares all rows."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(v):
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def same(spark, query, sql, folder=FOLDER):
    df = query(spark, folder)
    got, names = [tuple(r) for r in df.collect()], df.columns
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(names) == sorted(columns)
    at = [columns.index(c) for c in names]
    a = sorted(tuple(map(_norm, r)) for r in got)
    b = sorted(tuple(_norm(r[i]) for i in at) for r in cur.fetchall())
    assert a == b
