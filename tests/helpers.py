"""Comparison of queries with their SQL."""

import math
import os
import sys

import duckdb

TESTDATA = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def rows(df):
    """Sorted rows as tuples of plain Python values."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def views(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}" if os.path.isfile(f"{folder}/{name}") else f"{folder}/{name}/*.parquet"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def agree(spark, query, sql, folder=TESTDATA):
    """Assert equal columns and rows, in any order."""
    df = query(spark, folder)
    columns = sorted(df.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = views(folder).execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
