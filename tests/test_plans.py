"""Plans hold what the design promises."""

import pytest
from pyspark.sql import functions as F

from table_queries import QUERIES
from tablewright.operators import filters, patterns, profile, receipts, steps as S
from tablewright.operators.rules import Rule, validate
from tablewright.plans.pipeline import Pipeline
from tablewright.streaming import clean_stream, flag_stream


def plan(df):
    return df._jdf.queryExecution().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet")


def test_rules_read_the_table_once(orders):
    checks = [Rule("not_null", "o_custkey"), Rule("range", "o_totalprice", min=0),
              Rule("unique", "o_orderkey"), Rule("length", "o_orderstatus", max=1)]
    text = physical(validate(orders, checks))
    assert text.count("FileScan parquet") == 1
    assert "o_orderdate" not in text.split("ReadSchema")[1].split("\n")[0]


def test_filter_and_projection_reach_the_scan(orders):
    rows = filters.edit_columns(
        filters.filter_sql(orders, "o_totalprice > 1000"), {c: {"excluded": c != "o_orderkey"} for c in orders.columns}
    )
    text = physical(rows)
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_row_local_pipeline_is_one_stage_without_python(orders):
    out = Pipeline([S.Trim("o_orderpriority"), S.Case("o_orderpriority"), S.NumRound("o_totalprice", 10),
                    S.Hash("o_custkey"), S.Synth("o_orderstatus", "city"), S.Rename("o_orderstatus", "c")], "s").apply(orders)
    text = physical(out)
    assert "Exchange" not in text and "Python" not in text and "ArrowEval" not in text


@pytest.mark.parametrize(
    "step",
    [S.DedupKeys(("o_custkey",), "last", "o_orderdate"), S.Coarsen("o_totalprice", 10, "o_orderstatus", ("o_orderkey",)),
     S.Shuffle("o_orderpriority"), S.Synth("o_orderpriority", "autoEntity"),
     S.RecalcBalance("o_totalprice", "o_totalprice", "o_orderdate", 0, ("o_orderkey",))],
    ids=lambda s: s.kind,
)
def test_no_window_over_all_rows(orders, step):
    """Windows without partition keys stand only behind a bounded bucket table."""
    text = physical(Pipeline([step], "s").apply(orders))
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.split("\n"):
        if "Window [" in line and "], [" not in line.split("Window ", 1)[1].split("ASC", 1)[0]:
            assert "_rows" in line or "_total" in line or "_bucket" in line, line


def test_dedup_limits_rows_before_the_shuffle(orders):
    text = physical(Pipeline([S.DedupKeys(("o_custkey",), "first", "o_orderdate")]).apply(orders))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial")


def test_frequent_values_are_cut_before_the_shuffle(orders):
    text = physical(patterns.mask_census(orders, "o_orderpriority"))
    assert "WindowGroupLimit" in text
    assert "TakeOrderedAndProject" in physical(profile.top_values(orders, "o_custkey"))


def test_streams_take_row_local_steps(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).select(F.concat(F.lit(" a"), "id").alias("x")).write.parquet(source)
    stream = spark.readStream.schema("x string").parquet(source)
    cleaned = clean_stream(stream, Pipeline([S.Trim("x"), S.Case("x")]))
    flagged = flag_stream(cleaned, [Rule("regex", "x", pattern="A[0-9]")])
    q = flagged.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    rows = spark.table("cleaned").collect()
    assert len(rows) == 20 and sum(r._r0 for r in rows) == 10
    with pytest.raises(ValueError):
        clean_stream(stream, Pipeline([S.DedupExact()]))
    with pytest.raises(ValueError):
        flag_stream(stream, [Rule("unique", "x")])


def test_votes_are_one_small_pass_over_spread_rows(spark, orders):
    """Tests are in the plan once, not once per column, and rows are dealt out before them."""
    from tablewright.operators import scan

    wide = orders.select(*[F.concat("o_orderstatus", F.lit(str(i))).alias(f"c{i}") for i in range(12)])
    for votes, test in ((scan.pii_votes(wide), r"\A[A-Z]{6}"), (scan.clean_votes(wide), "= whole")):
        text = physical(votes)
        assert "RoundRobinPartitioning" in text
        assert text.count("FileScan parquet") == 1
        assert text.count(test) <= 4  # partial and final, formatted and not


def test_receipt_fields_work_on_all_cores_and_look_once(spark, folder):
    """A small file gives no single task, and the text around a total word is cut out once per word."""
    df = QUERIES["p10_receipt_fields"](spark, folder)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count("lower(substr") <= 3  # one for each tier of total words


def test_receipt_dates_in_all_notations(spark):
    text = "1.2.24 31/12/2023 32.1.2024 2024-13-01 2024-02-30 3. März 2024 4 foo 2024 5 may 1999 01.01.1999"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r.dates for r in receipts.extract_receipt_fields(df, "t").collect()]
    want = ["1999-05-05", "2023-12-31", "2024-02-01", "2024-02-30", "2024-03-03"]
    assert got == [want, []]
