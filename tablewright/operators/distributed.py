"""Whole-table orderings, lookups and quantiles that never pass through one task.

Ranks and running sums split the order into buckets, add up each bucket, and
add the few bucket totals to a window inside the bucket.  Lookups keep hot
keys away from the shuffle.  Nothing is capped or sampled away.
"""

from __future__ import annotations

import math
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.functions.columns import col, orderable
from tablewright.functions.hashing import row_hash

register_pickle_by_value(sys.modules[__name__])  # workers need no install

HEX_DIGITS = 3  # hash buckets: 16 ** 3, which bounds every offset table
MAX_BUCKETS = 4096
HOT_SHARE = 1000  # a key is hot from 1/1000 of all rows on, so at most 1000 keys are
COPY_CHUNK = 10_000
BLOCK_CHUNK = 65_536
NAN_CODE = (0x7FF << 52) + (1 << 51)
CODE_SHIFTS = (52, 39, 26, 13, 0)  # sign and exponent first, then the fraction in four parts


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of the warehouse, which is shared too, where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write out rows that hold random draws, so that a lost executor cannot redraw them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_rows(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cores; a small file with many rows would give a task or two."""
    context = df.sparkSession.sparkContext
    return df.repartition(max(context.defaultParallelism, bucket_count(df.sparkSession)))


# ---------------------------------------------------------------- order by hash


def hash_order(df: DataFrame, hash_col: str, tie: str, weight: str | None = None) -> DataFrame:
    """Rank distinct rows by hash: adds `_rank` (1-based) and, with weights, `_start` (0-based).

    An md5 is uniform, so its first digits make buckets of even size.
    """
    df = df.withColumn("_bucket", F.substring(col(hash_col), 1, HEX_DIGITS))
    sums = [F.count(F.lit(1)).alias("_rows")]
    if weight:
        sums.append(F.sum(col(weight)).alias("_mass"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("_bucket").agg(*sums)
    offsets = offsets.select(
        F.col("_bucket"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *(
            [F.coalesce(F.sum("_mass").over(before), F.lit(0)).alias("_mass_before")]
            if weight
            else []
        ),
    )
    inside = Window.partitionBy("_bucket").orderBy(col(hash_col), col(tie))
    out = df.join(F.broadcast(offsets), "_bucket").withColumn(
        "_rank", (F.row_number().over(inside) + F.col("_rows_before")).cast("bigint")
    )
    drop = ["_bucket", "_rows_before"]
    if weight:
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        start = F.sum(col(weight)).over(upto) - col(weight) + F.col("_mass_before")
        out = out.withColumn("_start", start.cast("bigint"))
        drop.append("_mass_before")
    return out.drop(*drop)


# ---------------------------------------------------------------- order by keys


def bucket_count(spark: SparkSession) -> int:
    return max(2, min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def range_buckets(df: DataFrame, keys: list[str], out: str = "_bucket") -> DataFrame:
    """Rows dealt out by Spark's range partitioning in the ascending order of `keys`, NULLs last.

    `out` is the number of the range.  The rows are written out once, so a range keeps its number
    and its rows whatever reads them, and however often.
    """
    order = [col(k).asc_nulls_last() for k in keys]
    return settle(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()))


def running_sum(
    df: DataFrame,
    value: Column,
    order_by: list[str],
    out: str,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Running sum of `value` in the ascending order of `order_by` (together unique), NULLs last.

    NULL values add nothing; the sum is NULL only until a value has been seen.  Works for one order
    over the whole table and for hot partitions alike: ranges cut across partitions.
    """
    groups = partition_by or []
    group_cols = [col(g) for g in groups]
    work = range_buckets(df.withColumn("_value", value), groups + order_by)
    totals = work.groupBy("_bucket", *group_cols).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group_cols).orderBy("_bucket")  # one row per range and group
    if not groups:
        earlier = Window.orderBy("_bucket")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_bucket").alias("_range"),
        *[col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.sum("_total").over(before).alias("_before"),
    )
    same = [F.col("_bucket") == F.col("_range")] + [
        col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)
    ]
    joined = work.join(offsets, same, "left")
    inside = (
        Window.partitionBy("_bucket", *group_cols)
        .orderBy(*[col(k).asc_nulls_last() for k in order_by])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    upto = F.sum("_value").over(inside)
    total = F.coalesce(upto + F.col("_before"), upto, F.col("_before"))
    drop = ["_value", "_bucket", "_range", "_before", *[f"_g{i}" for i in range(len(groups))]]
    return joined.withColumn(out, total).drop(*drop)


# ---------------------------------------------------------------- row identity


def expand_copies(counted: DataFrame, count_col: str, out: str) -> DataFrame:
    """One row per copy, numbered from 1; large counts are spread over tasks first."""
    n = col(count_col)
    few = counted.where(n <= COPY_CHUNK).withColumn(out, F.explode(F.sequence(F.lit(1), n)))
    first = F.explode(F.sequence(F.lit(1), n, F.lit(COPY_CHUNK)))
    many = (
        counted.where(n > COPY_CHUNK)
        .withColumn("_first", first)
        .repartition(bucket_count(counted.sparkSession), "_first", count_col)
    )
    last = F.least(F.col("_first") + COPY_CHUNK - 1, n)
    many = many.withColumn(out, F.explode(F.sequence(F.col("_first"), last))).drop("_first")
    return few.unionByName(many).drop(count_col)


def with_row_id(df: DataFrame, out: str = "_row_id") -> DataFrame:
    """A key per row: hash of the row and number of the copy.

    Equal rows are counted map-side and then numbered, so a group of copies
    that holds a third of the table stays spread out.
    """
    if len(orderable(df)) < len(df.columns):
        raise ValueError("rows with map columns need a key of their own")
    cols = [col(c) for c in df.columns]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    numbered = expand_copies(counted, "_n", "_copy")
    return numbered.withColumn(out, F.concat_ws("-", row_hash(cols), F.col("_copy"))).drop("_copy")


# ---------------------------------------------------------------- lookups


def lookup_join(df: DataFrame, key: list[str], lookup: DataFrame, weight: str) -> DataFrame:
    """Left join to a table with one row per key that also counts the key's rows.

    Keys with at least 1/1000 of all counted rows (so at most 1000 keys) are
    looked up by broadcast; their rows, and rows with a NULL key, are then
    spread over the shuffle by partition number, where they match nothing.
    """
    payload = [c for c in lookup.columns if c not in key and c != weight]
    total = lookup.agg(F.sum(col(weight))).scalar()
    hot = lookup.where(col(weight) * HOT_SHARE >= total)

    def side(source: DataFrame, tag: str, *extra: Column) -> DataFrame:
        return source.select(
            *[col(k).alias(f"_{tag}k{i}") for i, k in enumerate(key)],
            F.struct(*[col(p) for p in payload], F.lit(True).alias("_hit")).alias(f"_{tag}"),
            *extra,
        )

    def same(tag: str) -> Column:
        parts = [col(k) == F.col(f"_{tag}k{i}") for i, k in enumerate(key)]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    out = df.join(F.broadcast(side(hot, "hot")), same("hot"), "left")
    missing = F.col("_hot").isNotNull()
    for k in key:
        missing = missing | col(k).isNull()
    spread = F.lit(1) + F.pmod(F.spark_partition_id(), F.lit(1024))
    out = out.withColumn("_salt", F.when(missing, spread).otherwise(F.lit(0)))
    cold = side(lookup, "cold", F.lit(0).alias("_cold_salt"))
    out = out.join(cold, same("cold") & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(
        *[col(c) for c in df.columns],
        *[found.getField(p).alias(p) for p in payload],
        F.coalesce(found.getField("_hit"), F.lit(False)).alias("_hit"),
    )


def interval_lookup(
    points: DataFrame,
    index: str,
    intervals: DataFrame,
    start: str,
    length: str,
    block: Column,
) -> DataFrame:
    """Join each point to the interval [start, start + length) it falls into.

    Both sides meet on the block number floor(position / block); a long
    interval is laid out over all the blocks it covers, so its points stay in
    many tasks.
    """
    first = F.floor(col(start) / block)
    last = F.floor((col(start) + col(length) - 1) / block)
    laid = intervals.withColumn("_last", last).withColumn(
        "_from", F.explode(F.sequence(first, last, F.lit(BLOCK_CHUNK).cast("bigint")))
    )
    upto = F.least(F.col("_from") + BLOCK_CHUNK - 1, F.col("_last"))
    laid = laid.withColumn("_block", F.explode(F.sequence(F.col("_from"), upto)))
    laid = laid.drop("_from", "_last")
    placed = points.withColumn("_point_block", F.floor(col(index) / block))
    hit = (
        (F.col("_point_block") == F.col("_block"))
        & (col(index) >= col(start))
        & (col(index) < col(start) + col(length))
    )
    return placed.join(laid, hit).drop("_point_block", "_block")


# ---------------------------------------------------------------- quantiles


def order_codes(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles: their 64 bits, negated for negative values; NaN is largest.

    No value shares its code with another but 0.0 and -0.0.
    """
    bits = x.astype(np.float64).view(np.int64)
    size = bits & np.int64(0x7FFF_FFFF_FFFF_FFFF)
    return np.where(np.isnan(x), np.int64(NAN_CODE), np.where(bits < 0, -size, size))


def _digit_counts(groups: dict[tuple, int], before: int, shift: int):
    """Columns c0, c1, ... to (g, digit, n): values by their next bits, of each (column, bits known so far)."""
    width = before - shift

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in {i for i, _ in groups}:
                codes = order_codes(batch[f"c{i}"].drop_null().to_numpy()) >> shift
                known = codes >> width
                for bits, g in ((b, g) for (j, b), g in groups.items() if j == i):
                    low = -(1 << (width - 1)) if bits is None else bits << width
                    digits = codes if bits is None else codes[known == bits]
                    if len(digits):
                        if g not in sums:
                            sums[g] = np.zeros(1 << width, np.int64)
                        np.add.at(sums[g], digits - low, 1)
        for g, found in sums.items():
            digit = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(digit), g, np.int32)), pa.array(digit), pa.array(found[digit])],
                names=["g", "digit", "n"],
            )

    return counted


def coded_value(code: int) -> float:
    """The double of an order code."""
    value = struct.unpack("<d", struct.pack("<q", abs(code)))[0]
    return -value if code < 0 else value


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], counts: dict[str, int]
) -> dict[str, list[float | None]]:
    """Continuous quantiles of many columns; `counts` holds the non-null rows of each.

    Radix selection: every value has an order-preserving code of 64 bits.  A round counts, for all
    columns and wanted ranks, the values by the next bits of the code, among those that agree in the bits
    already known; there are as many rounds for ten rows as for any number.  A task holds at most 8,192
    counts for each rank, and two rows for each column and probability reach the driver.
    """
    names = [n for n in columns if counts[n]]
    values = df.select(*[columns[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    spark = df.sparkSession
    wanted = {
        (i, rank): (None, rank)  # bits known so far, and the rank among the values that have them
        for i, n in enumerate(names)
        for p in probs
        for rank in (math.floor(p * (counts[n] - 1)), math.ceil(p * (counts[n] - 1)))
    }
    before = 64
    for shift in CODE_SHIFTS if wanted else ():
        groups: dict[tuple, int] = {}
        for (i, _), (bits, _) in wanted.items():
            groups.setdefault((i, bits), len(groups))
        low = {
            g: -(1 << (before - shift - 1)) if bits is None else bits << (before - shift)
            for (_, bits), g in groups.items()
        }
        found = values.mapInArrow(_digit_counts(groups, before, shift), "g int, digit bigint, n bigint")
        found = found.groupBy("g", "digit").agg(F.sum("n").alias("n"))
        inside = Window.partitionBy("g").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("upto", F.sum("n").over(inside))
        pairs = sorted({(groups[i, bits], rank) for (i, _), (bits, rank) in wanted.items()})
        ranks = spark.createDataFrame(
            pa.table({"of": [g for g, _ in pairs], "rank": [rank for _, rank in pairs]})
        )
        here = (F.col("g") == F.col("of")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        hits = found.join(ranks, here & (F.col("rank") < F.col("upto")))
        picked = {
            (r["g"], r["rank"]): (low[r["g"]] + r["digit"], r["rank"] - r["upto"] + r["n"])
            for r in hits.collect()
        }
        wanted = {k: picked[groups[k[0], bits], rank] for k, (bits, rank) in wanted.items()}
        before = shift

    result: dict[str, list[float | None]] = {n: [None] * len(probs) for n in columns}
    for i, n in enumerate(names):
        for j, p in enumerate(probs):
            place = p * (counts[n] - 1)
            low, high = (coded_value(wanted[i, r][0]) for r in (math.floor(place), math.ceil(place)))
            even = low == high or math.isnan(low)
            result[n][j] = low if even else low + (high - low) * (place - math.floor(place))
    return result
