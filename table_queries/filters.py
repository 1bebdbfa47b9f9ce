"""Queries over projections, filters, facets and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from table_queries.registry import big, day, load, near, query
from tablewright.functions.columns import cell_text
from tablewright.operators import filters as f
from tablewright.operators import patterns
from tablewright.operators.pivot import Value, pivot_flat, pivot_matrix


@query(
    "c01_filter_sql",
    "SELECT o_orderkey, o_totalprice FROM orders "
    "WHERE o_totalprice > 250000 AND o_orderstatus <> 'P'",
)
def filter_sql(spark: SparkSession, folder: str) -> DataFrame:
    rows = f.filter_sql(load(spark, folder, "orders"), "o_totalprice > 250000 AND o_orderstatus <> 'P'")
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "c02_edit_columns",
    "SELECT o_orderkey AS order_no, o_custkey, o_orderstatus AS status, o_totalprice FROM orders "
    "WHERE o_orderpriority = '2-HIGH'",
)
def edit_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The filter sees the original names, the edits come after it."""
    rows = f.filter_sql(load(spark, folder, "orders"), "o_orderpriority = '2-HIGH'")
    edits = {
        "o_orderkey": {"rename": "order_no"},
        "o_orderstatus": {"rename": "status"},
        "o_orderdate": {"excluded": True},
        "o_orderpriority": {"excluded": True, "rename": "unused"},
        "gone": {"excluded": True},
    }
    return f.edit_columns(rows, edits)


@query("c03_project_range", "SELECT c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def project_range(spark: SparkSession, folder: str) -> DataFrame:
    rows = f.project_range(load(spark, folder, "customer"), 1, 3)
    return rows.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


_NULLED = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"


def _with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").withColumn("prio", F.expr(_NULLED))


@query(
    "c04_values_filter",
    f"SELECT o_orderkey, {_NULLED} AS prio FROM orders "
    f"WHERE {_NULLED} IN ('1-URGENT', '5-LOW') OR {_NULLED} IS NULL",
)
def values_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_nulls(spark, folder)
    chosen = f.ValuesFilter("prio", ("1-URGENT", "5-LOW"), include_null=True)
    return rows.where(chosen.condition(rows)).select("o_orderkey", "prio")


@query(
    "c05_range_filter",
    "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-06-30'",
)
def range_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders")
    chosen = f.RangeFilter("o_orderdate", "1997-01-01", "1998-06-30")
    return rows.where(chosen.condition(rows)).select("o_orderkey", day("o_orderdate"))


def _filters() -> list:
    return [
        f.ValuesFilter("o_orderstatus", ("F", "O")),
        f.RangeFilter("o_totalprice", "1000", "300000"),
        f.ValuesFilter("prio", ("2-HIGH",), include_null=True),
    ]


_WHERE = "o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice <= 300000"
_PRIO = f"({_NULLED} = '2-HIGH' OR {_NULLED} IS NULL)"


@query("c06_filter_set", f"SELECT o_orderkey FROM orders WHERE {_WHERE} AND {_PRIO}")
def filter_set(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_nulls(spark, folder)
    return rows.where(f.build_filter(rows, _filters())).select("o_orderkey")


@query(
    "c07_facet",
    f"SELECT {_NULLED} AS value, count(*) AS count, false AS truncated FROM orders "
    f"WHERE {_WHERE} GROUP BY 1",
)
def facet(spark: SparkSession, folder: str) -> DataFrame:
    return f.facet(_with_nulls(spark, folder), "prio", _filters())


@query(
    "c08_page",
    f"SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE {_WHERE} AND {_PRIO}) "
    f"AS total FROM orders WHERE {_WHERE} AND {_PRIO} ORDER BY o_orderkey LIMIT 100 OFFSET 200",
)
def page(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_nulls(spark, folder)
    total = f.filtered_count(rows, _filters()).scalar()
    third = f.page(rows, ["o_orderkey"], size=100, number=2, filters=_filters())
    return third.select("o_orderkey", "o_totalprice", total.alias("total"))


@query(
    "c09_value_completion",
    "SELECT DISTINCT c_name AS value FROM customer WHERE c_name ILIKE 'CUSTOMER#0000000%' "
    "ORDER BY 1 LIMIT 20",
)
def value_completion(spark: SparkSession, folder: str) -> DataFrame:
    return f.distinct_values(load(spark, folder, "customer"), "c_name", "CUSTOMER#0000000")


@query(
    "c10_match_records",
    "SELECT p_partkey, 'prefix' AS kind FROM part WHERE starts_with(p_name, 'red ') UNION ALL "
    "SELECT p_partkey, 'suffix' FROM part WHERE ends_with(p_name, ' bolt') UNION ALL "
    "SELECT p_partkey, 'token' FROM part WHERE contains(p_name, 'widget')",
)
def match_records(spark: SparkSession, folder: str) -> DataFrame:
    part = load(spark, folder, "part")
    wanted = (("prefix", "red "), ("suffix", " bolt"), ("token", "widget"))
    found = [
        patterns.match_records(part, "p_name", kind, value).select("p_partkey", F.lit(kind).alias("kind"))
        for kind, value in wanted
    ]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query(
    "m01_cell_text",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(value AS VARCHAR) END AS "
    "value, CAST(ts AS VARCHAR) AS ts, '{\"user_id\":' || user_id || ',\"event_type\":\"' || "
    "event_type || '\"}' AS nested FROM events",
)
def cell_texts(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"),
        "ts",
        F.struct("user_id", "event_type").alias("nested"),
    )
    return events.select(
        "event_id", *[cell_text(events, n).alias(n) for n in ("value", "ts", "nested")]
    )


@query(
    "l10_sample_rows",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY md5(concat_ws('|', "
    "o_orderkey, o_orderstatus, o_totalprice)) LIMIT 400",
)
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return f.sample_rows(orders, 400)


# ---------------------------------------------------------------- pivots


@query(
    "k01_pivot_flat",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS count_all, "
    "count(DISTINCT o_custkey) AS count_distinct_o_custkey, "
    "round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum_o_totalprice, "
    "round(avg(o_totalprice), 4) AS avg_o_totalprice, min(o_totalprice) AS min_o_totalprice, "
    "CAST(max(o_orderdate) AS VARCHAR) AS max_o_orderdate FROM orders GROUP BY 1, 2",
)
def flat(spark: SparkSession, folder: str) -> DataFrame:
    values = [
        Value("count_all"), Value("count_distinct", "o_custkey"), Value("sum", "o_totalprice"),
        Value("avg", "o_totalprice"), Value("min", "o_totalprice"), Value("max", "o_orderdate"),
    ]
    table = pivot_flat(load(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"], values)
    return table.select(
        "o_orderpriority", "o_orderstatus", "count_all", "count_distinct_o_custkey",
        near("sum_o_totalprice", "sum_o_totalprice", 2), near("avg_o_totalprice", "avg_o_totalprice"),
        "min_o_totalprice", day("max_o_orderdate"),
    )


_STATUS = "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END"


@query(
    "k02_pivot_matrix",
    "SELECT o_orderpriority, "
    + ", ".join(
        f"nullif(count(*) FILTER (WHERE {test}), 0) AS {name}_orders, "
        f"max(o_totalprice) FILTER (WHERE {test}) AS {name}_top"
        for name, test in (
            ("none", f"({_STATUS}) IS NULL"), ("f", f"({_STATUS}) = 'F'"),
            ("o", f"({_STATUS}) = 'O'"), ("p", f"({_STATUS}) = 'P'"),
        )
    )
    + " FROM orders GROUP BY o_orderpriority",
)
def matrix(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders").withColumn("status", F.expr(_STATUS))
    values = [Value("count_all"), Value("max", "o_totalprice")]
    table = pivot_matrix(orders, ["o_orderpriority"], "status", values)
    names = {"(leer)": "none", "F": "f", "O": "o", "P": "p"}
    return table.frame.select(
        "o_orderpriority",
        *[F.col(f"{k}_count_all").alias(f"{n}_orders") for k, n in names.items()],
        *[F.col(f"{k}_max_o_totalprice").alias(f"{n}_top") for k, n in names.items()],
    )


@query(
    "k03_sort_result",
    "SELECT p_brand, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE n END AS n FROM "
    "(SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY 2 DESC NULLS LAST, 1",
)
def sorted_result(spark: SparkSession, folder: str) -> DataFrame:
    table = pivot_flat(load(spark, folder, "part"), ["p_brand"], [Value("count_all")])
    n = F.when(F.col("p_brand") != "Brand#1", F.col("count_all"))
    return f.sort_result(table.select("p_brand", big(n, "n")), "n", descending=True)
