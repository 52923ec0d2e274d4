"""Runs a query and its SQL side by side on the smallest tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def compared(spark, query, sql):
    """(rows of the query, rows of the SQL), columns by name, rows in order."""
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([r[n] for n in names]) for r in df.collect())
    found = connection().sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    return got, sorted(repr([r[i] for i in at]) for r in found.fetchall())
