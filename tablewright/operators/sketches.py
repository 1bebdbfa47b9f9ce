"""Column profiles that can be put together: a table that grew is profiled by its new files alone.

A state is one row per column: counts, ranges, mean and sum of squares exactly, and three sketches:
HyperLogLog for distinct values, KLL for quantiles, frequent items for top values.  States of files,
days or partitions are kept as Parquet and merged by one aggregate over a few rows.

Errors: distinct counts have a relative standard error of 1.04 / sqrt(2 ** LOG_CELLS), 1.6 %; a quantile
has a rank within RANK_ERROR of the wanted one with 99 % probability; a top value is counted exactly while
at most TRACKED * 3 / 4 values differ, else its count is at most rows / (TRACKED * 0.29) too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import categories, col, text_of

LOG_CELLS = 12
RANK_CELLS = 800
RANK_ERROR = 0.005
TRACKED = 8192
TOP_VALUES = 20
QUARTILES = (0.25, 0.5, 0.75)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def profile_state(df: DataFrame) -> DataFrame:
    """The state of a table, in one aggregate; columns of nested type are left out.

    Columns: position, column, type, category, rows, filled, low, high, min, max, mean, squares,
    distinct_sketch, rank_sketch, top_sketch.  An empty table has a state too.
    """
    kinds = categories(df)
    names = [n for n in df.columns if kinds[n] != "complex"]
    texts = df.select(
        *[col(n).alias(f"v{i}") for i, n in enumerate(names)],
        *[text_of(df, n).alias(f"t{i}") for i, n in enumerate(names)],
    )
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        v, t = F.col(f"v{i}"), F.col(f"t{i}")
        aggregates += [
            F.count(v).alias(f"filled{i}"),
            F.min(v).cast("string").alias(f"min{i}"),
            F.max(v).cast("string").alias(f"max{i}"),
            F.hll_sketch_agg(t, LOG_CELLS).alias(f"distinct{i}"),
            F.expr(f"approx_top_k_accumulate(t{i}, {TRACKED})").alias(f"top{i}"),
        ]
        if kinds[n] in ("integer", "numeric"):
            x = v.cast("double")
            aggregates += [
                F.min(x).alias(f"low{i}"),
                F.max(x).alias(f"high{i}"),
                F.avg(x).alias(f"mean{i}"),
                (F.var_pop(x) * F.count(x)).alias(f"squares{i}"),
                F.kll_sketch_agg_double(x, RANK_CELLS).alias(f"rank{i}"),
            ]
    row = texts.agg(*aggregates)

    def state(i: int, n: str) -> Column:
        number = kinds[n] in ("integer", "numeric")

        def if_number(name: str, kind: str) -> Column:
            return F.col(f"{name}{i}") if number else F.lit(None).cast(kind)

        return F.struct(
            F.lit(i).alias("position"),
            F.lit(n).alias("column"),
            F.lit(df.schema[n].dataType.simpleString()).alias("type"),
            F.lit(kinds[n]).alias("category"),
            F.col("rows"),
            F.col(f"filled{i}").alias("filled"),
            if_number("low", "double").alias("low"),
            if_number("high", "double").alias("high"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
            if_number("mean", "double").alias("mean"),
            if_number("squares", "double").alias("squares"),
            F.col(f"distinct{i}").alias("distinct_sketch"),
            if_number("rank", "binary").alias("rank_sketch"),
            F.col(f"top{i}").alias("top_sketch"),
        )

    return row.select(F.inline(F.array(*[state(i, n) for i, n in enumerate(names)])))


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all tables together, from the rows of their states.

    Columns of the same name and type go together; a column whose type changed has a row per type.
    """
    n, mean = F.col("filled"), F.col("mean")
    number = F.col("category").isin("integer", "numeric")
    whole = F.sum(F.when(n > 0, n * mean)) / F.nullif(F.sum(n), F.lit(0))
    spread = F.sum("squares") + F.sum(F.when(n > 0, n * mean * mean)) - F.sum(n) * whole * whole
    return states.groupBy("column", "type", "category").agg(
        F.min("position").alias("position"),
        F.sum("rows").alias("rows"),
        F.sum("filled").alias("filled"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.coalesce(F.min_by("min", F.when(number, F.col("low"))), F.min("min")).alias("min"),
        F.coalesce(F.max_by("max", F.when(number, F.col("high"))), F.max("max")).alias("max"),
        whole.alias("mean"),
        F.when(spread < 0, 0.0).otherwise(spread).alias("squares"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(number, F.kll_merge_agg_double("rank_sketch", RANK_CELLS)).alias("rank_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("top_sketch"),
    ).select(*states.columns)


def state_summary(states: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """(column, type, min, max, distinct, avg, std, q25, q50, q75, count, null_percentage, top_values).

    One row per row of a state; top_values are (value, count), most frequent first.
    """
    filled = F.col("filled")
    ranked = filled > 0
    quartiles = [
        F.when(ranked, F.kll_sketch_get_quantile_double("rank_sketch", F.lit(q))).alias(f"q{int(q * 100)}")
        for q in QUARTILES
    ]
    values = F.expr(f"approx_top_k_estimate(top_sketch, {top})")
    return states.orderBy("position").select(
        "column",
        "type",
        "min",
        "max",
        F.least(F.hll_sketch_estimate("distinct_sketch"), filled).alias("distinct"),
        F.col("mean").alias("avg"),
        F.sqrt(F.col("squares") / F.nullif(filled, F.lit(0))).alias("std"),
        *quartiles,
        F.col("rows").alias("count"),
        (100.0 * (F.col("rows") - filled) / F.nullif(F.col("rows"), F.lit(0))).alias("null_percentage"),
        F.transform(
            F.filter(values, lambda e: e["item"].isNotNull()),
            lambda e: F.struct(e["item"].alias("value"), e["count"].alias("count")),
        ).alias("top_values"),
    )
