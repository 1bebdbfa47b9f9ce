import math
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions.masks import compact_display, mask_regex
from tablewright.operators import patterns


def column(spark, values, name="code"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_mask_regex(spark):
    row = spark.range(1).select(
        mask_regex(F.lit("AA-99")).alias("e"),
        mask_regex(F.lit("A-9"), True).alias("c"),
        mask_regex(F.lit("a.a")).alias("m"),
        compact_display(F.lit("A-9")).alias("d1"),
        compact_display(F.lit("A9a")).alias("d2"),
    ).first()
    assert row.e == r"^\p{Lu}{2}-\d{2}$"
    assert row.c == r"^\p{Lu}+-\d+$"
    assert row.m == r"^\p{Ll}\.\p{Ll}$"
    assert (row.d1, row.d2) == ("A+-9+", "A+9+a+")


def test_census(spark):
    df = column(spark, ["AB-12", "CD-34", "EF-56", None])
    rows = {r["mode"]: r for r in patterns.mask_census(df, "code").collect()}
    assert (rows["exact"].pat, rows["exact"].c, rows["exact"].example) == ("AA-99", 3, "AB-12")
    assert rows["compact"].pat == "A-9"
    stats = patterns.mask_stats(df, "code").first()
    assert (stats.total, stats.nulls, stats.distinct_exact, stats.distinct_compact) == (4, 1, 1, 1)


def verdict(spark, counts, total):
    rows = [("exact", p, c) for p, c in counts]
    census = spark.createDataFrame(rows, "mode string, pat string, c bigint")
    return patterns.pattern_outliers(census, total).first()


def test_outlier_verdicts(spark):
    v = verdict(spark, [("AA-99", 90), ("AAA-99", 10)], 100)
    assert (v.has_dominant, v.outlier_count, v.normal) == (True, 10, ["AA-99"])
    v = verdict(spark, [("A", 50), ("B", 45), ("C", 5)], 100)
    assert (v.outlier_count, v.normal) == (5, ["A", "B"])
    v = verdict(spark, [("Aaaaa", 30), ("Aaaa", 25), ("Aaaaaa", 20)], 100)
    assert (v.has_dominant, v.outlier_count) == (False, 0)


def test_outlier_rows(spark):
    df = column(spark, ["AB-12", "CD-34", "EF-56", "XYZ-999", None])
    assert [tuple(r) for r in patterns.outlier_rows(df, "code", ["AA-99"]).collect()] == [
        ("XYZ-999", "AAA-999")
    ]
    assert patterns.outlier_rows(df, "code", []).count() == 0


def test_segments(spark):
    values = [f"BAU_{i}_LTD" for i in range(1, 9)] + [f"GEN_POWER_{i}" for i in range(1, 7)]
    df = column(spark, values + ["X_POWER_END"] * 3, "asset")
    found = {(r.kind, r.value): r.c for r in patterns.segments(df, "asset").collect()}
    assert found["prefix", "BAU_"] == 8 and found["prefix", "GEN_"] == 6
    assert found["suffix", "_LTD"] == 8
    assert found["token", "POWER"] == 9 and found["token", "BAU"] == 8


def test_substrings(spark):
    values = (
        [f"HYDROPOWERUNIT{i}" for i in range(1, 7)]
        + [f"SOLARPOWERSTATION{i}" for i in range(1, 6)]
        + [f"POWERGRID{i}" for i in range(1, 4)]
    )
    rows = patterns.substrings(column(spark, values, "asset"), "asset").collect()
    found = [r.value for r in rows]
    assert (rows[0].value, rows[0].c) == ("POWER", 14)
    assert "OWER" not in found and "POWE" not in found
    assert "HYDROPOWERUNIT" in found


def test_match_records(spark):
    df = column(spark, ["BAU_1", "BAU_2", "GEN_1"])
    assert patterns.match_records(df, "code", "prefix", "BAU_").count() == 2
    assert patterns.match_records(df, "code", "suffix", "_1").count() == 2


def plain_counts(values, min_len, max_len, least):
    counts = {}
    for v in set(values) - {None}:
        for g in {v[i : i + k] for k in range(min_len, max_len + 1) for i in range(len(v) - k + 1)}:
            counts[g] = counts.get(g, 0) + 1
    return {g: c for g, c in counts.items() if c >= least}


@pytest.mark.parametrize(("share", "shape"), [(0.1, (3, 24)), (0.002, (1, 5)), (0.05, (2, 2))])
def test_substring_counts_by_brute_force(spark, monkeypatch, share, shape):
    """Repeats inside a value, copies, empty and very long values, NULLs, batches of a few rows."""
    monkeypatch.setattr(patterns, "SUFFIXES_AT_ONCE", 50)
    draw = random.Random(8)
    values = ["".join(draw.choices("abé😀", k=draw.randint(0, 30))) for _ in range(300)]
    values += ["a" * 4000, "ab" * 500, "", None, "copy"] + ["copy of many"] * 200
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    df = column(spark, values, "v")
    got = {r.gram: r.c for r in patterns.substring_counts(df, "v", *shape, share).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    least = max(2, math.ceil(share * sum(v is not None for v in values)))
    assert got == plain_counts(values, *shape, least)


def test_substring_jobs_do_not_grow_with_the_length(spark):
    df = column(spark, [f"unit {i} of the power station" for i in range(50)], "v")
    jobs = []
    for longest in (5, 24):
        spark.sparkContext.setJobGroup(f"grams-{longest}", "")
        found = patterns.substring_counts(df, "v", 3, longest)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grams-{longest}")))
        assert found.count() > 10
    spark.sparkContext.setJobGroup("", "")
    assert jobs == [jobs[0]] * 2 and jobs[0] <= 2


def test_substrings_without_a_motif(spark):
    assert patterns.substrings(column(spark, [None, "", "ab"], "v"), "v").collect() == []
