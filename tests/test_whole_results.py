"""Results are whole by default: no row, value, bucket or character is cut."""

import glob

import pytest
from pyspark.sql import functions as F

from tablewright.operators import filters, impact, patterns, pivot, profile
from tablewright.sources import writers


def test_documents_hold_all_rows(spark, tmp_path):
    df = spark.range(120_000).select("id", F.lit("x").alias("t"))
    writers.write_markdown(df, str(tmp_path / "m"))
    files = glob.glob(f"{tmp_path}/m/part-*")
    lines = [line for f in files for line in open(f).read().splitlines()]
    assert len(files) > 1 and len(lines) == 120_000 + 2 * len(files)
    writers.write_html(df, str(tmp_path / "h"))
    pages = [open(f).read() for f in glob.glob(f"{tmp_path}/h/part-*")]
    assert sum(p.count("<tr><td>") for p in pages) == 120_000
    assert all(p.startswith("<!DOCTYPE html>") and p.rstrip().endswith("</html>") for p in pages)


def test_glue_stands_between_all_rows(spark, tmp_path):
    df = spark.range(25_000).coalesce(1)
    writers.write_json_array(df, str(tmp_path / "j"))
    text = open(glob.glob(f"{tmp_path}/j/part-*")[0]).read()
    assert text.startswith("[\n") and text.rstrip().endswith("}\n]") and text.count("},\n") == 24_999


def test_time_buckets_of_three_centuries(spark):
    days = spark.range(300).select(F.make_date(F.col("id").cast("int") + 1700, F.lit(1), F.lit(1)).alias("d"))
    assert profile.time_buckets(days, "d").count() == 300
    assert profile.time_buckets(days, "d", 7).count() == 7
    row = profile.profile(days).first()
    assert len(row["time_buckets"]) == 300


def test_facets_segments_and_pivots(spark):
    df = spark.range(6_000).select(F.concat(F.lit("K"), "id").alias("v"), (F.col("id") % 3).alias("g"))
    assert filters.facet(df, "v").count() == 6_000
    assert filters.facet(df, "v", cap=5).filter("truncated").count() == 5
    names = spark.range(600).select(F.concat(F.lit("p"), F.floor(F.col("id") / 2), F.lit("_x")).alias("s"))
    assert patterns.segments(names, "s").filter("kind = 'prefix'").count() == 300
    wide = spark.range(500).select((F.col("id") % 250).alias("c"), "id")
    found = pivot.pivot_matrix(wide, [], "c", [pivot.Value("count_all")])
    assert found.total_columns == 250 and len(found.labels) == 250 and not found.truncated
    with pytest.raises(ValueError):
        pivot.pivot_matrix(spark.range(10_001), [], "id", [pivot.Value("count_all")])


def test_motifs_behind_the_fortieth_character(spark):
    rows = [(f"{chr(65 + i) * 45}COMMON{i}",) for i in range(20)]
    df = spark.createDataFrame(rows, "v string")
    found = {r["value"]: (r["c"], r["example"]) for r in patterns.substrings(df, "v").collect()}
    assert found["COMMON"] == (20, rows[0][0])


def test_example_reads_the_whole_column(spark):
    rows = [(f" text {i}",) for i in range(40)] + [(f"{i % 28 + 1:02d}.0{i % 9 + 1}.2020",) for i in range(60)]
    df = spark.createDataFrame(rows, "d string")
    pairs = impact.example(df, "parseDate", "d", limit=100).collect()
    assert sum(r["after"] is not None for r in pairs) > 40


def test_profile_of_nulls_and_many_columns(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    row = profile.profile(df).first()
    assert [h["count"] for h in row["histogram"]] == [1] + [0] * 28 + [1]
    wide = spark.range(50).select(
        *[(F.col("id") * (i + 1)).alias(f"n{i}") for i in range(30)],
        *[F.concat(F.lit(f"t{i}-"), "id").alias(f"t{i}") for i in range(30)],
    )
    found = {r["column"]: r for r in profile.profile(wide).collect()}
    assert len(found) == 60 and found["t7"]["top_values"][0]["label"] == "t7-0"
    assert found["n3"]["median"] == 98.0


def test_nested_json_with_a_dot_in_a_key(spark, tmp_path):
    path = tmp_path / "n.json"
    path.write_text('{"a.b": {"c": [{"x": 1}, {"x": 2}]}}')
    from tablewright.sources import readers

    assert [r["x"] for r in readers.read_json_nested(spark, str(path)).orderBy("x").collect()] == [1, 2]
    found = readers.read_json_nested(spark, str(path), "$.`a.b`.c")
    assert found.count() == 2


def test_scan_of_a_table_of_nested_columns(spark):
    from tablewright.operators import scan

    df = spark.range(3).select(F.struct("id").alias("s"))
    assert scan.scan_pii(df).count() == 0
