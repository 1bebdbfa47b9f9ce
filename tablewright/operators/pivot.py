"""Pivot tables, flat and as a matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import categories, col, text_of

NULL_LABEL = "(leer)"

_ANY = ("integer", "numeric", "string", "temporal", "boolean", "binary", "other")
_RANGE = ("integer", "numeric", "temporal", "string")
# Aggregate names and the kinds of column each accepts.
AGGREGATES = {
    "count_all": (),
    "count": _ANY,
    "count_distinct": _ANY,
    "sum": ("integer", "numeric"),
    "avg": ("integer", "numeric"),
    "min": _RANGE,
    "max": _RANGE,
}


@dataclass(frozen=True)
class Value:
    """An aggregate over a field; count_all needs none."""

    agg: str
    field: str | None = None

    @property
    def label(self) -> str:
        return self.agg if self.field is None else f"{self.agg}_{self.field}"

    def column(self, df: DataFrame) -> Column:
        if self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.agg}")
        if self.agg == "count_all":
            return F.count(F.lit(1)).alias(self.label)
        if categories(df)[self.field] not in AGGREGATES[self.agg]:
            raise ValueError(f"{self.agg} does not apply to {self.field}")
        f = {
            "count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg,
            "min": F.min, "max": F.max,
        }[self.agg]
        return f(col(self.field)).alias(self.label)


def pivot_flat(df: DataFrame, rows: list[str], values: list[Value]) -> DataFrame:
    """Aggregates per row fields, in their order; without row fields one grand total."""
    values = [v for v in values if v.agg == "count_all" or v.field]
    if not values:
        raise ValueError("a pivot needs at least one value")
    out = df.groupBy(*[col(r) for r in rows]).agg(*[v.column(df) for v in values])
    return out.orderBy(*[col(r).asc_nulls_last() for r in rows]) if rows else out


@dataclass(frozen=True)
class Matrix:
    """A pivot with one output column per kept column value and aggregate."""

    frame: DataFrame
    labels: tuple[str, ...]
    total_columns: int
    truncated: bool


def pivot_matrix(
    df: DataFrame, rows: list[str], column: str, values: list[Value], cap: int | None = None
) -> Matrix:
    """Row fields down, values of `column` across (numbers by size, text by code point).

    All values get a column, up to what Spark allows for a pivot
    (spark.sql.pivotMaxValues), beyond which it raises with the number;
    pivot_flat with the column among the row fields has no such bound.  `cap`
    asks for the first values only, with a flag and the true number.  NULL shows
    as "(leer)".  Eager for the list of column values.
    """
    label = F.coalesce(text_of(df, column), F.lit(NULL_LABEL))
    labels = df.select(label.alias("label")).distinct()
    number = F.col("label").try_cast("double")
    plain = (number.isNotNull()) | (F.col("label") == NULL_LABEL)
    total, numeric = labels.agg(F.count(F.lit(1)), F.bool_and(plain)).first()
    order = [number.asc_nulls_first()] if numeric else []
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if cap is None and total > most:
        raise ValueError(f"{column} has {total} values, more than the {most} columns of a pivot")
    wanted = labels.orderBy(*order, "label").limit(most if cap is None else cap)
    kept = [r["label"] for r in wanted.collect()]
    aggregates = [v.column(df) for v in values]
    out = df.withColumn("_label", label)
    if total > len(kept):
        out = out.where(F.col("_label").isin(kept))
    out = out.groupBy(*[col(r) for r in rows]).pivot("_label", kept).agg(*aggregates)
    names = [f"{k}_{v.label}" for k in kept for v in values]
    out = out.toDF(*rows, *names)
    out = out.orderBy(*[col(r).asc_nulls_last() for r in rows]) if rows else out
    return Matrix(out, tuple(kept), total, total > len(kept))
