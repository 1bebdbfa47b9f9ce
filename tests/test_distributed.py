"""The distributed orderings against plain Python, with hot keys and copies."""

import math
import random
import statistics
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import distributed as d


def test_running_sum_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(50), i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, v bigint").repartition(5)
    got = {r.i: r.s for r in d.running_sum(df, F.col("v"), ["k", "i"], "s").collect()}
    total = 0
    for k, i, v in sorted(rows):
        total += v
        assert got[i] == total


def test_running_sum_per_group_with_nulls(spark):
    rng = random.Random(2)
    rows = [(None if i % 3 == 0 else i % 4, rng.choice([None, 1, 2, 3]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, k int, i int")
    got = {r.i: r.n for r in d.running_sum(df, F.lit(1), ["k", "i"], "n", ["g"]).collect()}
    seen = {}
    low = lambda v: (v is None, v)
    for g, k, i in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2])):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


@pytest.mark.parametrize("partitions", [2, 64])
def test_running_sum_with_null_values_and_keys(spark, partitions):
    rows = [(None if i % 7 == 0 else i * 37 % 500, i, i % 10 if i % 2 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, i int, v bigint")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.i: r.s for r in d.running_sum(df, F.col("v"), ["k", "i"], "s").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    total = None
    for _, i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        total = total if v is None else (total or 0) + v
        assert got[i] == total


@pytest.mark.parametrize("dtype", ["string", "timestamp_ntz", "double", "decimal(10,2)", "date"])
def test_range_buckets_keep_the_order(spark, dtype):
    df = spark.range(2000).select(
        (F.col("id") * 37 % 1000).cast("int").cast("string").alias("t"), F.col("id").alias("i")
    )
    value = {
        "string": F.col("t"),
        "timestamp_ntz": F.timestamp_seconds(F.col("t").cast("int") * 1000).cast("timestamp_ntz"),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("t").cast("int")),
    }.get(dtype, F.col("t").cast(dtype))
    df = df.select(value.alias("k"), "i")
    rows = d.range_buckets(df, ["k", "i"]).orderBy(F.col("k").asc_nulls_last(), "i").collect()
    buckets = [r._bucket for r in rows]
    assert len(rows) == 2000 and buckets == sorted(buckets)


def test_hash_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("v"), (F.col("id") % 9 + 1).alias("w"))
    df = df.withColumn("h", F.md5("v"))
    rows = d.hash_order(df, "h", "v", "w").orderBy("h").collect()
    assert [r._rank for r in rows] == list(range(1, 501))
    start = 0
    for r in rows:
        assert r._start == start
        start += r.w


def test_row_ids_number_copies(spark, monkeypatch):
    monkeypatch.setattr(d, "COPY_CHUNK", 10)
    rows = [("a", 1)] * 37 + [("b", None)] * 2 + [("c", 3)]
    df = spark.createDataFrame(rows, "x string, y int")
    out = d.with_row_id(df)
    assert out.select("_row_id").distinct().count() == 40
    assert sorted(map(str, out.drop("_row_id").collect())) == sorted(map(str, df.collect()))


def test_lookup_join_hot_cold_and_null_keys(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k")
    )
    lookup = df.where("k IS NOT NULL AND k % 2 = 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    lookup = lookup.withColumn("p", F.col("k") * 2)
    rows = d.lookup_join(df, ["k"], lookup, "n").collect()
    assert len(rows) == 5000
    for r in rows:
        hit = r.k is not None and r.k % 2 == 1
        assert r._hit is hit and r.p == (r.k * 2 if hit else None)


def test_interval_lookup_with_a_long_interval(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHUNK", 4)
    intervals = spark.createDataFrame([("a", 0, 5), ("hot", 5, 900), ("z", 905, 95)], "v string, s bigint, n bigint")
    points = spark.range(1000).select(F.col("id").alias("i"))
    rows = d.interval_lookup(points, "i", intervals, "s", "n", F.lit(7)).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.v == ("a" if r.i < 5 else "hot" if r.i < 905 else "z")


def test_exact_quantiles_with_a_hot_value(spark):
    rng = random.Random(4)
    xs = [5.0 if rng.random() < 0.4 else round(rng.gauss(5, 3), 3) for _ in range(4001)]
    ys = [rng.random() for _ in range(3000)]
    rows = [(x, ys[i] if i < 3000 else None) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "x double, y double")
    cols = {"x": F.col("x"), "y": F.col("y")}
    got = d.exact_quantiles(df, cols, [0.5, 0.25, 0.75, 0.0, 1.0], {"x": 4001, "y": 3000})
    for name, data in (("x", xs), ("y", ys)):
        q = statistics.quantiles(data, n=4, method="inclusive")
        want = [q[1], q[0], q[2], min(data), max(data)]
        assert got[name] == pytest.approx(want)


ODD = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324,
       1.7976931348623157e308, 0.1, 3.0, 2.0**53, 2.0**53 + 2, 1 - 2.0**-53, 1 + 2.0**-52, 1e-310, 2.0**1023]


def test_order_codes_are_the_bits():
    rng = random.Random(6)
    values = ODD + [-v for v in ODD] + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    for x, code in zip(values, d.order_codes(np.array(values)).tolist()):
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert code == (d.NAN_CODE if x != x else -bits if x < 0 else bits)
        assert x != x or d.coded_value(code) == x


def test_exact_quantiles_of_odd_values(spark):
    """Ties, both zeros, subnormal numbers, infinities, NaN as the largest, one value, no value."""
    rng = random.Random(7)
    xs = [rng.choice(ODD) for _ in range(501)]
    df = spark.createDataFrame([(x, 7.5 if i == 9 else None, None) for i, x in enumerate(xs)],
                               "x double, one double, none double")
    probs = [0.0, 0.004, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = d.exact_quantiles(df, {c: F.col(c) for c in df.columns}, probs, {"x": 501, "one": 1, "none": 0})
    ordered = sorted(xs, key=lambda x: (x != x, x))
    for p, value in zip(probs, got["x"]):
        place = p * 500
        low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
        want = low if low == high or low != low else low + (high - low) * (place - math.floor(place))
        assert value == want or (value != value and want != want)
    assert got["one"] == [7.5] * 7 and got["none"] == [None] * 7


def test_exact_quantiles_gather_no_values(spark):
    """The same rounds for ten rows and for many, and no buffer of values in any plan."""
    seen = []
    for n in (10, 20_000):
        df = spark.range(n).select((F.col("id") * 0.5).alias("x"))
        job_group = f"quantiles-{n}"
        spark.sparkContext.setJobGroup(job_group, "")
        got = d.exact_quantiles(df, {"x": F.col("x")}, [0.5], {"x": n})
        assert got["x"] == [(n - 1) / 4]
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(job_group)))
    spark.sparkContext.setJobGroup("", "")
    assert seen[0] == seen[1]
    assert "percentile" not in open(d.__file__, encoding="utf-8").read()
