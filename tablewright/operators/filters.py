"""Projections, filters and facets."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.casts import convert
from tablewright.functions.columns import all_of, col, text_of



def filter_sql(df: DataFrame, where: str) -> DataFrame:
    """Rows that meet a Spark SQL condition; a blank condition keeps all."""
    return df.where(where) if where.strip() else df


def edit_columns(df: DataFrame, edits: dict[str, dict]) -> DataFrame:
    """Drop and rename by original name: {name: {"rename": new, "excluded": bool}}.

    Names the table does not have are ignored; dropping every column changes
    nothing.
    """
    kept = [c for c in df.columns if not edits.get(c, {}).get("excluded")]
    if not kept:
        return df
    return df.select(*[col(c).alias(edits.get(c, {}).get("rename") or c) for c in kept])


def project_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Columns start..end by position; an empty or full range changes nothing."""
    start, end = max(0, start), min(end, len(df.columns) - 1)
    return df.select(*[col(c) for c in df.columns[start : end + 1]]) if start <= end else df


@dataclass(frozen=True)
class ValuesFilter:
    """Column value in a list, NULL wanted or not; nothing chosen keeps no row."""

    column: str
    values: tuple[Any, ...] = ()
    include_null: bool = False

    def condition(self, df: DataFrame) -> Column:
        c, dtype = col(self.column), df.schema[self.column].dataType
        out = F.lit(False)
        if self.values:
            texts = [
                F.lit(v) if not isinstance(v, str) else convert(F.lit(v), T.StringType(), _target(dtype))
                for v in self.values
            ]
            out = F.coalesce(c.isin(texts), F.lit(False))
        return out | c.isNull() if self.include_null else out


@dataclass(frozen=True)
class RangeFilter:
    """Column between bounds given as text; a bound that does not fit the type matches nothing."""

    column: str
    min: Any = None
    max: Any = None
    include_null: bool = False

    def condition(self, df: DataFrame) -> Column:
        c, target = col(self.column), _target(df.schema[self.column].dataType)
        parts = []
        for bound, op in ((self.min, "ge"), (self.max, "le")):
            if bound is None or bound == "":
                continue
            limit = convert(F.lit(str(bound)), T.StringType(), target)
            parts.append(c >= limit if op == "ge" else c <= limit)
        if not parts:
            return c.isNull() if self.include_null else F.lit(True)
        out = F.coalesce(all_of(parts), F.lit(False))
        return out | c.isNull() if self.include_null else out


def _target(dtype: T.DataType) -> str:
    names = {"string": "VARCHAR", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP"}
    simple = dtype.simpleString()
    return names.get(simple, simple.upper())


def build_filter(
    df: DataFrame, filters: list[ValuesFilter | RangeFilter], exclude: str | None = None
) -> Column:
    """All column filters together, one column's own filter left out on request."""
    return all_of([f.condition(df) for f in filters if f.column != exclude])


def facet(df: DataFrame, column: str, filters: list = (), cap: int | None = None) -> DataFrame:
    """(value, count, truncated): values under the other columns' filters, most frequent first.

    NULL is a value of its own; `cap` asks for the first values only, and `truncated` says whether
    it cut.
    """
    rows = df.where(build_filter(df, list(filters), exclude=column))
    counts = rows.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    if cap is None:
        return ordered.withColumn("truncated", F.lit(False))
    distinct = counts.agg(F.count(F.lit(1))).scalar()
    return ordered.limit(cap).withColumn("truncated", distinct > cap)


def filtered_count(df: DataFrame, filters: list) -> DataFrame:
    return df.where(build_filter(df, filters)).agg(F.count(F.lit(1)).alias("count"))


def page(
    df: DataFrame, order_by: list[str], size: int = 100, number: int = 0, filters: list = ()
) -> DataFrame:
    """Page `number` (from 0) of the filtered rows in the order of a key."""
    rows = df.where(build_filter(df, list(filters)))
    return rows.orderBy(*[col(c) for c in order_by]).offset(size * number).limit(size)


def distinct_values(df: DataFrame, column: str, prefix: str = "", limit: int = 20) -> DataFrame:
    """(value): smallest distinct values that start with a prefix in any case."""
    rows = df.where(col(column).isNotNull())
    if prefix:
        rows = rows.where(F.lower(text_of(df, column)).startswith(prefix.lower()))
    return rows.select(col(column).alias("value")).distinct().orderBy("value").limit(limit)


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """The `n` rows with the smallest md5: a sample that is the same every time.

    Each task keeps its own `n` smallest, so nothing is sorted as a whole.
    """
    texts = [F.coalesce(text_of(df, c), F.lit("")) for c in df.columns]
    return df.orderBy(F.md5(F.concat_ws("|", *texts))).limit(n)


def sort_result(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Sort by one column, NULLs last in both directions."""
    c = col(key)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
