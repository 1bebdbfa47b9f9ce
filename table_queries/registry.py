"""Registration of queries and helpers they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.operators.distributed import shared_folder
from tablewright.sources.readers import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, whole."""
    return read_parquet(spark, f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the cluster's shared folder."""
    return f"{shared_folder(spark)}/tablewright-{uuid.uuid4().hex}"


def day(name: str) -> Column:
    """A date or time as text, so that both engines print the same."""
    return F.col(name).cast("string").alias(name)


def big(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name)


def near(c: Column | str, name: str, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits).alias(name)


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_draw(value: str, modulus: int | str, salt: str = "", suffix: str = "") -> str:
    """The number a value draws, in SQL."""
    text = f"({value} || '{salt}{suffix}')" if salt + suffix else f"({value})"
    return f"(('0x' || substr(md5({text}), 1, 15))::BIGINT % {modulus})"


def sql_unit(key: str, seed: int) -> str:
    """The double in 0 .. 1 that a row key draws, in SQL."""
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
