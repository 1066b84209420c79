"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

import os
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def compare(spark, data, query, sql):
    df = query(spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=repr)
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
