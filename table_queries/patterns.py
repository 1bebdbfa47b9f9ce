"""Queries over masks, segments and substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from table_queries.registry import load, near, query
from tablewright.functions.columns import text_of
from tablewright.functions.masks import mask
from tablewright.operators import patterns


def sql_mask(value: str, compact: bool = False) -> str:
    q = "+" if compact else ""
    for cls, symbol in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), ("[0-9]", "9")):
        value = f"regexp_replace({value}, '{cls}{q}', '{symbol}', 'g')"
    return value


@query(
    "g01_mask",
    f"SELECT page_id, {sql_mask('url')} AS exact, {sql_mask('url', True)} AS compact FROM pages",
)
def masks(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "pages")
    text = text_of(pages, "url")
    return pages.select("page_id", mask(text).alias("exact"), mask(text, True).alias("compact"))


_CENSUS = (
    "WITH m AS (SELECT 'exact' AS mode, {e} AS pat, {c} AS ex FROM {t} WHERE {c} IS NOT NULL UNION ALL "
    "SELECT 'compact', {k}, {c} FROM {t} WHERE {c} IS NOT NULL), g AS (SELECT mode, pat, count(*) AS c, "
    "min(ex) AS example FROM m GROUP BY ALL), census AS (SELECT *, row_number() OVER (PARTITION BY mode "
    "ORDER BY c DESC, pat) AS rank FROM g QUALIFY rank <= 30) "
)


def census_sql(table: str, column: str) -> str:
    return _CENSUS.format(t=table, c=column, e=sql_mask(column), k=sql_mask(column, True))


@query("g02_mask_census", census_sql("pages", "url") + "SELECT mode, rank, pat, c, example FROM census")
def mask_census(spark: SparkSession, folder: str) -> DataFrame:
    census = patterns.mask_census(load(spark, folder, "pages"), "url")
    return census.select("mode", "rank", "pat", "c", "example")


@query(
    "g02_mask_stats",
    f"SELECT count(*) AS total, 0::BIGINT AS nulls, count(DISTINCT {sql_mask('url')}) AS distinct_exact, "
    f"count(DISTINCT {sql_mask('url', True)}) AS distinct_compact FROM pages",
)
def mask_stats(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.mask_stats(load(spark, folder, "pages"), "url")


@query(
    "g03_mask_regex",
    "SELECT 'exact' AS mode, '^\\p{Lu}\\p{Ll}{7}#\\d{9}$' AS regex, 'Aaaaaaaa#999999999' AS display, "
    "count(*) AS c FROM customer UNION ALL "
    "SELECT 'compact', '^\\p{Lu}+\\p{Ll}+#\\d+$', 'A+a+#9+', count(*) FROM customer",
)
def mask_regex(spark: SparkSession, folder: str) -> DataFrame:
    """Regular expression and display form of the masks of all customer names."""
    census = patterns.mask_census(load(spark, folder, "customer"), "c_name")
    return census.select("mode", "regex", "display", "c")


_ODD = "CASE WHEN c_custkey % 8 = 0 THEN 'x-' || c_custkey ELSE c_name END"


def _odd(spark: SparkSession, folder: str) -> DataFrame:
    odd = F.concat(F.lit("x-"), F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_custkey") % 8 == 0, odd).otherwise(F.col("c_name"))
    return load(spark, folder, "customer").select("c_custkey", name.alias("name"))


@query(
    "g04_pattern_outliers",
    "SELECT mode, true AS has_dominant, round(count(*) FILTER (WHERE c_custkey % 8 <> 0) / count(*), 6) AS "
    "top_share, count(*) FILTER (WHERE c_custkey % 8 = 0) AS outlier_count, "
    "CASE mode WHEN 'exact' THEN 'Aaaaaaaa#999999999' ELSE 'Aa#9' END AS normal "
    "FROM customer, (SELECT unnest(['exact', 'compact']) AS mode) GROUP BY mode",
)
def pattern_outliers(spark: SparkSession, folder: str) -> DataFrame:
    df = _odd(spark, folder)
    known = df.agg(F.count("name")).scalar()
    verdict = patterns.pattern_outliers(patterns.mask_census(df, "name"), known)
    return verdict.select(
        "mode", "has_dominant", near("top_share", "top_share", 6), "outlier_count",
        F.array_join("normal", " ").alias("normal"),
    )


@query(
    "g05_outlier_rows",
    f"SELECT {_ODD} AS value, {sql_mask(_ODD)} AS mask FROM customer WHERE c_custkey % 8 = 0",
)
def outlier_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = _odd(spark, folder)
    return patterns.outlier_rows(df, "name", patterns.dominant_masks(df, "name"), limit=None)


@query(
    "g06_segments",
    "WITH s AS (SELECT 'prefix' AS kind, regexp_extract(url, '^[[:alnum:]]+[^[:alnum:]]') AS value, url AS ex "
    "FROM pages UNION ALL SELECT 'suffix', regexp_extract(url, '[^[:alnum:]][[:alnum:]]+$'), url FROM pages "
    "UNION ALL SELECT 'token', unnest(regexp_split_to_array(regexp_replace(url, '([a-z])([A-Z])', '\\1 \\2', "
    "'g'), '[^[:alnum:]]+')), url FROM pages), g AS (SELECT kind, value, count(*) AS c, min(ex) AS example "
    "FROM s WHERE value <> '' AND (kind <> 'token' OR length(value) >= 2) GROUP BY ALL HAVING count(*) >= 2) "
    "SELECT * FROM g",
)
def segments(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.segments(load(spark, folder, "pages"), "url")


_GRAMS = (
    "WITH v AS (SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL), n AS (SELECT greatest(2, "
    "ceil(count(*) * 0.1::DOUBLE)) AS support FROM v), g AS (SELECT substring(v, pos, len) AS gram, v FROM "
    "(SELECT DISTINCT v FROM v), range(3, 25) AS l(len), range(1, length(v) - len + 2) AS p(pos) WHERE "
    "length(v) >= len), f AS (SELECT gram, count(DISTINCT v) AS c, min(v) AS example FROM g GROUP BY gram "
    "HAVING count(DISTINCT v) >= (SELECT support FROM n)) "
)


@query(
    "g07_substrings",
    _GRAMS.format(c="url", t="pages") + "SELECT gram, c FROM f",
)
def substring_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every substring that a tenth of the addresses holds."""
    return patterns.substring_counts(load(spark, folder, "pages"), "url")


_MAXIMAL = (
    ", top AS (SELECT * FROM f), sets AS (SELECT "
    "length(gram) AS len, list({{'g': gram, 'c': c}}) AS items FROM top GROUP BY 1), walk AS (SELECT 25 AS "
    "len, [{{'g': '', 'c': 0::BIGINT}}] AS kept UNION ALL SELECT len - 1, kept || coalesce(list_filter((SELECT "
    "items FROM sets WHERE sets.len = walk.len - 1), lambda x: len(list_filter(kept, lambda k: contains(k.g, "
    "x.g) AND k.c >= x.c * 0.8)) = 0), []) FROM walk WHERE len > 3), kept AS (SELECT unnest(kept) AS k FROM "
    "walk WHERE len = 3) SELECT k.g AS value, k.c AS c, example FROM kept JOIN f ON gram = k.g ORDER BY k.c "
    "DESC, length(k.g) DESC, k.g LIMIT 40"
).replace("{{", "{").replace("}}", "}")


@query(
    "g08_maximal_substrings",
    "WITH RECURSIVE " + _GRAMS.format(c="p_name", t="part")[5:] + _MAXIMAL,
)
def substrings(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.substrings(load(spark, folder, "part"), "p_name", limit=40)
