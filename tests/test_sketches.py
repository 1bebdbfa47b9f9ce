"""Mergeable profile states against exact figures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile, sketches


def table(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice([None, rng.gauss(0, 1e6)]), f"v{int(rng.paretovariate(1))}", rng.random() < 0.2, [1])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, x double, t string, b boolean, l array<int>")


def summary(states):
    return {r["column"]: r for r in sketches.state_summary(states).collect()}


def test_merged_states_equal_the_whole(spark, tmp_path):
    df = table(spark)
    for i in range(5):
        part = df.where(F.col("id") % 5 == i) if i < 4 else df.where(F.col("id") % 5 == 4)
        sketches.profile_state(part).write.mode("append").parquet(str(tmp_path))
    sketches.profile_state(df.limit(0)).write.mode("append").parquet(str(tmp_path))
    merged = summary(sketches.merge_states(spark.read.parquet(str(tmp_path))))
    whole = summary(sketches.profile_state(df))
    assert list(merged) == ["id", "x", "t", "b"]
    for name, row in whole.items():
        other = merged[name]
        for field in ("type", "min", "max", "count", "null_percentage"):
            assert other[field] == row[field]
        assert abs(other["distinct"] - row["distinct"]) <= 0.05 * row["distinct"]
    assert merged["x"].avg == pytest.approx(whole["x"].avg) and merged["x"].std == pytest.approx(whole["x"].std)
    assert merged["t"].top_values[:3] == whole["t"].top_values[:3]


def test_estimates_stay_within_the_stated_errors(spark):
    df = table(spark, 20_000, seed=2)
    found, exact = summary(sketches.profile_state(df)), {r["column"]: r for r in profile.summarize(df, False).collect()}
    for name in ("id", "x", "t"):
        error = 3 * 1.04 / 2 ** (sketches.LOG_CELLS / 2)
        assert abs(found[name]["distinct"] / exact[name]["distinct"] - 1) <= error
    xs = sorted(r.x for r in df.select("x").collect() if r.x is not None)
    for q, name in zip(sketches.QUARTILES, ("q25", "q50", "q75")):
        rank = sum(v <= found["x"][name] for v in xs) / len(xs)
        assert abs(rank - q) <= sketches.RANK_ERROR
    assert found["x"]["std"] == pytest.approx(statistics.pstdev(xs))
    counted = df.groupBy("t").count().orderBy(F.desc("count"), "t").limit(3).collect()
    assert [(v.value, v["count"]) for v in found["t"].top_values[:3]] == [(r.t, r["count"]) for r in counted]


def test_states_of_nothing(spark):
    df = table(spark, 10)
    for empty in (df.limit(0), df.select(F.lit(None).cast("double").alias("x"))):
        for state in (sketches.profile_state(empty), sketches.merge_states(sketches.profile_state(empty))):
            for row in sketches.state_summary(state).collect():
                assert row.distinct == 0 and row["min"] is None and row.avg is None and row.q50 is None
                assert row.top_values == []
