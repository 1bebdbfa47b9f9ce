"""Queries over column profiles and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from table_queries.registry import big, load, near, query, scratch
from tablewright.operators import profile, sketches
from tablewright.operators.distributed import exact_quantiles
from tablewright.sources import footer

_ORDERS = (
    ("o_orderkey", "bigint", "integer"), ("o_custkey", "bigint", "integer"),
    ("o_orderstatus", "string", "string"), ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "temporal"), ("o_orderpriority", "string", "string"),
)


@query(
    "f01_describe",
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{n}' AS \"column\", '{t}' AS type, '{c}' AS category, "
        f"count(*) AS total FROM orders"
        for i, (n, t, c) in enumerate(_ORDERS)
    ),
)
def describe(spark: SparkSession, folder: str) -> DataFrame:
    """The schema beside the counts of each column."""
    orders = load(spark, folder, "orders")
    listed = profile.describe(orders).join(profile.null_counts(orders), "column")
    return listed.select("position", "column", "type", "category", "total")


def _holes(spark: SparkSession, folder: str) -> DataFrame:
    """Events with NULLs in two columns."""
    key = F.col("event_id")
    return load(spark, folder, "events").select(
        "event_id",
        "ts",
        F.when(key % 3 != 0, F.col("user_id")).alias("user_id"),
        F.when(key % 7 != 0, F.col("event_type")).alias("event_type"),
        "value",
    )


_HOLES = (
    "(SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, "
    "CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, value FROM events)"
)
_HOLE_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")


@query(
    "f02_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS total, count({c}) AS non_null, "
        f"count(*) - count({c}) AS nulls FROM {_HOLES}"
        for c in _HOLE_COLUMNS
    ),
)
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.null_counts(_holes(spark, folder))


_LINES = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    "f03_distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in _LINES
    ),
)
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_counts(load(spark, folder, "lineitem"))


@query(
    "f03_distinct_text",
    "SELECT 'text' AS \"column\", count(DISTINCT text) AS \"distinct\" FROM documents UNION ALL "
    "SELECT 'lang', count(DISTINCT lang) FROM documents UNION ALL "
    "SELECT 'doc_id', count(DISTINCT doc_id) FROM documents",
)
def distinct_text(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_counts(load(spark, folder, "documents").select("text", "lang", "doc_id"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_suppkey")


@query(
    "f04_numeric_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
        f"round(avg({c}), 4) AS avg, round(stddev_pop({c}), 4) AS std, "
        f"round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS median, "
        f"round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS q1, "
        f"round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS q3 FROM lineitem"
        for c in _NUMBERS
    ),
)
def numeric_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = profile.numeric_stats(load(spark, folder, "lineitem"), list(_NUMBERS))
    return stats.select(
        "column", "min", "max", *[near(c, c) for c in ("avg", "std", "median", "q1", "q3")]
    )


@query(
    "f05_histogram",
    "WITH b AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem), c AS "
    "(SELECT least(30, greatest(1, CAST(floor((l_extendedprice - mn) / (mx - mn) * 30) AS BIGINT) + 1)) "
    "AS bin, count(*) AS n FROM lineitem, b GROUP BY 1), r AS (SELECT unnest(range(1, 31)) AS bin) "
    "SELECT r.bin, round(mn + (r.bin - 1) * ((mx - mn) / 30), 4) AS lower, "
    "round(mn + r.bin * ((mx - mn) / 30), 4) AS upper, coalesce(n, 0) AS count "
    "FROM r LEFT JOIN c USING (bin), b",
)
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = profile.histogram(load(spark, folder, "lineitem"), "l_extendedprice")
    return bins.select("bin", near("lower", "lower"), near("upper", "upper"), "count")


@query(
    "f06_top_values",
    "SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def top_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(load(spark, folder, "lineitem"), "l_partkey")


@query(
    "f07_length_stats",
    "SELECT 'text' AS \"column\", min(length(text)) AS min_len, max(length(text)) AS max_len, "
    "round(avg(length(text)), 4) AS avg_len FROM documents UNION ALL "
    "SELECT 'source', min(length(source)), max(length(source)), round(avg(length(source)), 4) "
    "FROM documents",
)
def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = profile.length_stats(load(spark, folder, "documents"), ["text", "source"])
    return stats.select("column", "min_len", "max_len", near("avg_len", "avg_len"))


@query(
    "f08_time_buckets",
    "SELECT 'day' AS bucket, strftime(date_trunc('day', ts), '%Y-%m-%d') AS label, count(*) AS count "
    "FROM events GROUP BY 2 UNION ALL SELECT 'year', strftime(o_orderdate, '%Y'), count(*) FROM orders "
    "GROUP BY 2",
)
def time_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Events span a month, orders several years."""
    days = profile.time_buckets(load(spark, folder, "events"), "ts")
    return days.unionAll(profile.time_buckets(load(spark, folder, "orders"), "o_orderdate"))


@query(
    "f09_bool_counts",
    "SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax > 0.04 END AS value, count(*) AS count "
    "FROM lineitem GROUP BY 1",
)
def bool_counts(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_tax") > 0.04).alias("taxed")
    return profile.bool_counts(load(spark, folder, "lineitem").select(flag), "taxed")


def _kpi_sql() -> str:
    n = len(_HOLE_COLUMNS)
    sums = " + ".join(f"count({c})" for c in _HOLE_COLUMNS)
    full = " + ".join(f"(count({c}) = count(*))::BIGINT" for c in _HOLE_COLUMNS)
    uniq = " + ".join(f"least(1.0::DOUBLE, count(DISTINCT {c}) / count({c}))" for c in _HOLE_COLUMNS)
    keys = " + ".join(
        f"(count(DISTINCT {c}) = count(*) AND count({c}) = count(*))::BIGINT" for c in _HOLE_COLUMNS
    )
    return (
        f"SELECT {n}::BIGINT AS columns, count(*) AS rows, round(({sums}) / ({n} * count(*)), 6) AS "
        f"fill_rate, {full} AS full_columns, 0::BIGINT AS empty_columns, round(({uniq}) / {n}, 6) AS "
        f"uniqueness, {keys} AS key_candidates, 0::BIGINT AS constant_columns FROM {_HOLES}"
    )


@query("f10_quality_kpis", _kpi_sql())
def quality_kpis(spark: SparkSession, folder: str) -> DataFrame:
    kpis = profile.quality_kpis(_holes(spark, folder))
    return kpis.select(
        "columns", "rows", near("fill_rate", "fill_rate", 6), "full_columns", "empty_columns",
        near("uniqueness", "uniqueness", 6), "key_candidates", "constant_columns",
    )


_FOOTER_KINDS = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "numeric",
    "o_orderdate": "temporal", "o_orderpriority": "string",
}


@query(
    "f11_footer_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) - count({c}) AS null_count, "
        f"CAST(min({c}){cast} AS VARCHAR) AS min, CAST(max({c}){cast} AS VARCHAR) AS max, true AS packed FROM orders"
        for c, kind in _FOOTER_KINDS.items()
        for cast in ["::DOUBLE" if kind == "integer" else ""]
    ),
)
def footer_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the table; sizes agree with those of its chunks."""
    path = f"{folder}/orders.parquet"
    chunks = footer.parquet_metadata(spark, path).groupBy("path_in_schema").agg(
        F.sum("compressed").alias("small"), F.sum("uncompressed").alias("large"), F.count(F.lit(1)).alias("parts")
    )
    found = footer.footer_profile(spark, path).join(chunks, F.col("path_in_schema") == F.col("column"))
    packed = (
        (F.col("compressed") == F.col("small")) & (F.col("uncompressed") == F.col("large"))
        & (F.col("chunks") == F.col("parts")) & F.col("ratio").between(0.01, 1.2)
    )
    time = F.col("kind") == "temporal"
    return found.select(
        "column", "kind", "null_count",
        *[F.when(time, F.col(c).try_cast("timestamp_ntz").cast("string")).otherwise(F.col(c)).alias(c)
          for c in ("min", "max")],
        packed.alias("packed"),
    )


@query(
    "f12_footer_summary",
    "SELECT 1::BIGINT AS files, count(*) AS rows, '2 int, 1 num, 2 str, 1 dt' AS type_mix, "
    "true AS sized FROM orders",
)
def footer_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = footer.footer_summary(spark, f"{folder}/orders.parquet")
    sized = (F.col("compressed") > 0) & (F.col("uncompressed") > 0) & (F.col("bytes_per_row") > 0)
    return found.select("files", "rows", "type_mix", sized.alias("sized"))


def _profile_sql() -> str:
    parts = []
    for i, (n, t, c) in enumerate(_ORDERS):
        number, text, time = c in ("integer", "numeric"), c == "string", c == "temporal"
        top = (
            f"(SELECT CAST(v AS VARCHAR) || ':' || k FROM (SELECT {n} AS v, count(*) AS k FROM orders "
            "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1))"
        )
        parts.append(
            f"SELECT {i}::BIGINT AS position, '{n}' AS \"column\", '{c}' AS category, "
            f"count({n}) AS non_null, count(DISTINCT {n}) AS \"distinct\", "
            + (f"round(avg({n}), 4)" if number else "NULL::DOUBLE") + " AS avg, "
            + (f"round(quantile_cont({n}, 0.5)::DOUBLE, 4)" if number else "NULL::DOUBLE")
            + " AS median, "
            + (f"max(length({n}))" if text else "NULL::BIGINT") + " AS max_len, "
            + (f"CAST(max({n}) AS VARCHAR)" if time else "NULL::VARCHAR") + " AS max_text, "
            + (top if text else "NULL::VARCHAR") + " AS top, "
            + ("30::BIGINT" if number else "NULL::BIGINT") + " AS bins, "
            + ("count(*)" if number else "NULL::BIGINT") + " AS in_bins, "
            + (f"count(DISTINCT year({n}))" if time else "NULL::BIGINT") + " AS buckets FROM orders"
        )
    return " UNION ALL ".join(parts)


@query("f13_profile", _profile_sql())
def full_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The whole profile; nested lists are shown by their size and first entry."""
    found = profile.profile(load(spark, folder, "orders"))
    top = F.get("top_values", F.lit(0))
    size = F.when(F.col("histogram").isNotNull(), F.size("histogram"))
    return found.select(
        "position", "column", "category", "non_null", "distinct", near("avg", "avg"),
        near("median", "median"), "max_len", "max_text",
        F.concat(top["label"], F.lit(":"), top["count"]).alias("top"),
        big(size, "bins"),
        F.aggregate("histogram", F.lit(0).cast("bigint"), lambda a, b: a + b["count"]).alias("in_bins"),
        big(F.when(F.col("time_buckets").isNotNull(), F.size("time_buckets")), "buckets"),
    )


@query(
    "f13_profile_bins",
    "WITH t AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS x FROM orders), m AS (SELECT "
    "min(x) AS lo, max(x) AS hi FROM t), b AS (SELECT CAST(least(30, greatest(1, floor((x - lo) / (hi - lo) "
    "* 30) + 1)) AS BIGINT) AS bin, count(*) AS n FROM t, m WHERE x IS NOT NULL GROUP BY 1) "
    "SELECT r AS bin, coalesce(n, 0) AS count FROM range(1, 31) AS s(r) LEFT JOIN b ON bin = r",
)
def profile_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Every bin of a column with NULLs."""
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price")
    found = profile.profile(load(spark, folder, "orders").select(price))
    return found.select(F.posexplode("histogram").alias("bin", "h")).select(
        (F.col("bin") + 1).cast("bigint").alias("bin"), F.col("h.count").alias("count")
    )


@query(
    "k04_summarize",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
        f"count(DISTINCT {c}) AS \"distinct\", "
        + (f"round(avg({c}), 4)" if num else "NULL::DOUBLE") + " AS avg, "
        + (f"round(quantile_cont({c}, 0.25)::DOUBLE, 4)" if num else "NULL::DOUBLE") + " AS q25, "
        + f"count(*) AS count, round(100.0 * (count(*) - count({c})) / count(*), 4)::DOUBLE AS "
        f"null_percentage FROM {_HOLES}"
        for c, num in (("event_id", 1), ("ts", 0), ("user_id", 1), ("event_type", 0), ("value", 1))
    ),
)
def summarize(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.summarize(_holes(spark, folder), approx=False)
    return found.select(
        "column", "min", "max", "distinct", near("avg", "avg"), near("q25", "q25"), "count",
        near("null_percentage", "null_percentage"),
    )


def _close(spark: SparkSession, found: DataFrame, df: DataFrame) -> DataFrame:
    """A summary with its estimates judged against exact figures: 5 % for distinct values (three standard
    errors), the stated rank error for quartiles."""
    exact = profile.distinct_counts(df).withColumnRenamed("distinct", "exact")
    numbers = [c for c in df.columns if c not in ("ts", "event_type")]
    counts = df.agg(*[F.count(c).alias(c) for c in numbers]).first().asDict()
    e = sketches.RANK_ERROR
    probs = [p + d for p in sketches.QUARTILES for d in (-e, e)]
    bounds = exact_quantiles(df, {c: F.col(c) for c in numbers}, probs, counts)
    limits = spark.createDataFrame(
        [(c, *bounds[c]) for c in numbers], "column string, " + ", ".join(f"b{i} double" for i in range(6))
    )
    inside = [F.col(f"q{q}").between(F.col(f"b{2 * i}"), F.col(f"b{2 * i + 1}")) for i, q in enumerate((25, 50, 75))]
    judged = found.join(exact, "column").join(limits, "column", "left")
    return judged.select(
        "column", "type", "min", "max", near("avg", "avg"), near("std", "std"), "count",
        near("null_percentage", "null_percentage"),
        (F.abs(F.col("distinct") / F.col("exact") - 1) <= 0.05).alias("distinct_near"),
        (inside[0] & inside[1] & inside[2]).alias("quartiles_near"),
        *([F.transform("top_values", lambda v: F.concat_ws(":", v["value"], v["count"])).alias("top")]
          if "top_values" in found.columns else []),
    )


def _summary_sql(extra: str = "") -> str:
    kinds = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double"}

    def one(c: str, kind: str) -> str:
        number = kind in ("bigint", "double")
        return (
            f"SELECT '{c}' AS \"column\", '{kind}' AS type, CAST(min({c}) AS VARCHAR) AS min, "
            f"CAST(max({c}) AS VARCHAR) AS max, "
            + (f"round(avg({c}), 4) AS avg, round(stddev_pop({c}), 4) AS std, " if number else
               "NULL::DOUBLE AS avg, NULL::DOUBLE AS std, ")
            + f"count(*) AS count, round(100.0 * (count(*) - count({c})) / count(*), 4)::DOUBLE AS null_percentage, "
            f"true AS distinct_near, {'true' if number else 'NULL::BOOLEAN'} AS quartiles_near{extra} FROM {_HOLES}"
        )

    return " UNION ALL ".join(one(c, kind) for c, kind in kinds.items())


@query("k04_summarize_approx", _summary_sql())
def summarize_approx(spark: SparkSession, folder: str) -> DataFrame:
    """The default path: sketches, within their stated errors."""
    df = _holes(spark, folder)
    return _close(spark, profile.summarize(df), df)


@query(
    "f13_merged_states",
    f"SELECT s.*, CASE WHEN \"column\" = 'event_type' THEN t.top END AS top FROM ({_summary_sql()}) s, "
    "(SELECT array_to_string(list(event_type || ':' || n ORDER BY n DESC, event_type), ',') AS top FROM "
    f"(SELECT event_type, count(*) AS n FROM {_HOLES} WHERE event_type IS NOT NULL GROUP BY 1)) t",
)
def merged_states(spark: SparkSession, folder: str) -> DataFrame:
    """States of three parts of a table, kept as Parquet and put together, against the whole table."""
    df = _holes(spark, folder)
    path = scratch(spark)
    for i in range(3):
        part = df.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i)
        sketches.profile_state(part).write.mode("append").parquet(path)
    merged = sketches.merge_states(spark.read.parquet(path))
    out = _close(spark, sketches.state_summary(merged), df)
    kind = F.col("column") == "event_type"
    return out.withColumn("top", F.when(kind, F.array_join(F.array_sort("top", lambda a, b: F.coalesce(
        F.nullif(F.split(b, ":")[1].cast("int") - F.split(a, ":")[1].cast("int"), F.lit(0)),
        F.when(a < b, -1).otherwise(1))), ",")))
