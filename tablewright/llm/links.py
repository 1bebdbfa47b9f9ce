"""Connected components of links, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import settled


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a smaller one in reach, component the smallest of them.

    Each round hangs the neighbours of a node on the smallest of them, first the larger ones, then
    the smaller ones, until only stars are left.  A round is two aggregations with map-side minima
    and two joins; it is written to the shared folder, so lineage stays short.  Links to NULL or to
    itself and repeated links are ignored; no links give no rows.
    """
    now = settled(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u != v")
        .distinct(),
        "links",
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(
                F.explode(
                    F.when(
                        F.col("v") != F.col("m"),
                        F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                F.struct("u", F.col("m").alias("v"))),
                    ).otherwise(F.array(F.struct("u", F.col("m").alias("v"))))
                ).alias("e")
            )
            .select("e.u", "e.v")
            .distinct()
        )
        new = settled(small, "links")
        new_mark = _mark(new)
        if new_mark == mark:
            return new.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, mark = new, new_mark
