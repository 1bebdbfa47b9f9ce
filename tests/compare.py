"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
from pyspark.sql import SparkSession


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value both engines print the same."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value + 0.0))
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


def compare(spark: SparkSession, con, fn, sql: str, folder: str) -> str | None:
    """None when both give the same rows, else what differs."""
    df = fn(spark, folder)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = table(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}: {mine[:3]} / {theirs[:3]}"
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:3]
        lacking = [r for r in theirs if r not in set(mine)][:3]
        return f"only Spark {extra}\n   only SQL {lacking}"
    return None
