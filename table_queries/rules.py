"""Queries over data-quality rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from table_queries.registry import load, near, query
from tablewright.operators import rules
from tablewright.operators.rules import Rule, validate


def counts(df: DataFrame, *checks: Rule) -> DataFrame:
    return validate(df, list(checks)).select("rule_no", "type", "status", "violations")


def expect(table: str, *checks: tuple[str, str]) -> str:
    """Violations per rule as SQL: (type, condition of a breaking row)."""
    parts = [
        f"SELECT {i}::BIGINT AS rule_no, '{t}' AS type, CASE WHEN count(*) FILTER (WHERE {c}) > 0 THEN "
        f"'fail' ELSE 'pass' END AS status, count(*) FILTER (WHERE {c}) AS violations FROM {table}"
        for i, (t, c) in enumerate(checks)
    ]
    return " UNION ALL ".join(parts)


_HOLES = (
    "(SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS prio, "
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders)"
)


def holes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, folder, "orders").select(
        "*",
        F.when(key % 17 != 0, F.col("o_orderpriority")).alias("prio"),
        F.when(key % 9 != 0, F.col("o_custkey")).alias("cust"),
    )


@query("h01_not_null", expect(_HOLES, ("not_null", "prio IS NULL"), ("not_null", "o_orderkey IS NULL")))
def not_null(spark: SparkSession, folder: str) -> DataFrame:
    return counts(holes(spark, folder), Rule("not_null", "prio"), Rule("not_null", "o_orderkey"))


@query(
    "h02_unique",
    expect(
        _HOLES,
        ("unique", "cust IN (SELECT cust FROM " + _HOLES + " WHERE cust IS NOT NULL GROUP BY cust "
         "HAVING count(*) > 1)"),
        ("unique", "(cust, prio) IN (SELECT (cust, prio) FROM " + _HOLES + " WHERE cust IS NOT NULL AND "
         "prio IS NOT NULL GROUP BY cust, prio HAVING count(*) > 1)"),
        ("unique", "false"),
    ),
)
def unique(spark: SparkSession, folder: str) -> DataFrame:
    """One column, two columns with NULLs, and a true key."""
    return counts(
        holes(spark, folder),
        Rule("unique", "cust"), Rule("unique", cols=("cust", "prio")), Rule("unique", "o_orderkey"),
    )


@query(
    "h03_allowed",
    expect(
        _HOLES,
        ("allowed", "prio IS NOT NULL AND prio NOT IN ('1-URGENT', '2-HIGH', '5-LOW')"),
        ("allowed", "cust IS NOT NULL AND cust NOT IN (1, 2, 3)"),
        ("allowed", "true"),
    ),
)
def allowed(spark: SparkSession, folder: str) -> DataFrame:
    return counts(
        holes(spark, folder),
        Rule("allowed", "prio", values=("1-URGENT", "2-HIGH", "5-LOW")),
        Rule("allowed", "cust", values=("1", "2", "3")),
        Rule("allowed", "prio", values=()),
    )


@query(
    "h04_range",
    expect(
        _HOLES,
        ("range", "NOT (o_totalprice >= 1000 AND o_totalprice <= 400000)"),
        ("range", "NOT (o_totalprice > 50000)"),
        ("range", "TRY_CAST(substr(prio, 1, 1) AS DOUBLE) > 3"),
        ("range", "false"),
    ),
)
def in_range(spark: SparkSession, folder: str) -> DataFrame:
    """Inclusive, exclusive, numbers in a text column, and text that is no number."""
    df = holes(spark, folder).withColumn("level", F.substring("prio", 1, 1))
    return counts(
        df,
        Rule("range", "o_totalprice", min=1000, max=400000),
        Rule("range", "o_totalprice", min=50000, exclusive=True),
        Rule("range", "level", max=3),
        Rule("range", "prio", min=1, max=2),
    )


@query(
    "h05_length",
    expect(_HOLES, ("length", "length(prio) < 6"), ("length", "length(prio) > 10 OR length(prio) < 3")),
)
def length(spark: SparkSession, folder: str) -> DataFrame:
    return counts(
        holes(spark, folder), Rule("length", "prio", min=6), Rule("length", "prio", min=3, max=10)
    )


@query(
    "h06_regex",
    expect(
        _HOLES,
        ("regex", "NOT regexp_full_match(prio, '[1-3]-[A-Z]+')"),
        ("regex", "NOT regexp_full_match(CAST(o_orderkey AS VARCHAR), '\\d*[02468]|1\\d*')"),
    ),
)
def regex(spark: SparkSession, folder: str) -> DataFrame:
    return counts(
        holes(spark, folder),
        Rule("regex", "prio", pattern="[1-3]-[A-Z]+"),
        Rule("regex", "o_orderkey", pattern=r"\d*[02468]|1\d*"),
    )


@query(
    "h07_pattern",
    expect(
        "customer",
        ("pattern", "c_custkey % 50 = 0"),
        ("pattern", "c_custkey % 50 = 0"),
    ),
)
def pattern(spark: SparkSession, folder: str) -> DataFrame:
    """One customer in fifty has a name of another shape."""
    odd = F.when(F.col("c_custkey") % 50 == 0, "unknown").otherwise(F.col("c_name"))
    customer = load(spark, folder, "customer").withColumn("c_name", odd)
    return counts(customer, Rule("pattern", "c_name"), Rule("pattern", "c_name", mode="compact"))


_TEXT = (
    "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN 'none' "
    "WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END"
)


@query(
    "h08_castable",
    expect(
        f"(SELECT {_TEXT} AS t FROM orders)",
        *[
            ("castable", f"t IS NOT NULL AND TRY_CAST(t AS {k}) IS NULL")
            for k in ("DOUBLE", "BIGINT", "DATE", "TIMESTAMP")
        ],
        ("castable", "false"),
    ),
)
def castable(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    text = (
        F.when(key == 0, F.col("o_totalprice").cast("string"))
        .when(key == 1, "none")
        .when(key == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    df = load(spark, folder, "orders").select(text.alias("t"))
    kinds = ("DOUBLE", "BIGINT", "DATE", "TIMESTAMP", "NOSUCHTYPE")
    return counts(df, *[Rule("castable", "t", as_type=k) for k in kinds])


@query("h09_trimmed", expect("documents", ("trimmed", "doc_id % 5 = 0"), ("trimmed", "text <> trim(text)")))
def trimmed(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    source = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit(" "))).otherwise(F.col("source"))
    return counts(docs.withColumn("source", source), Rule("trimmed", "source"), Rule("trimmed", "text"))


_KNOWN = "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0"


@query(
    "h10_reference",
    expect(
        _HOLES,
        ("reference", f"cust IS NOT NULL AND cust NOT IN ({_KNOWN})"),
        ("reference", "false"),
    ),
)
def reference(spark: SparkSession, folder: str) -> DataFrame:
    """A list without NULL, and one with a NULL, which proves nothing absent."""
    customer = load(spark, folder, "customer")
    known = customer.where("c_custkey % 3 <> 0")
    gaps = customer.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("c_custkey"))
    return counts(
        holes(spark, folder),
        Rule("reference", "cust", ref=known, ref_col="c_custkey"),
        Rule("reference", "cust", ref=gaps, ref_col="c_custkey"),
    )


@query("h11_sql", expect(_HOLES, ("sql", "o_totalprice > 450000 AND prio = '5-LOW'"), ("sql", "false")))
def sql_rule(spark: SparkSession, folder: str) -> DataFrame:
    return counts(
        holes(spark, folder),
        Rule("sql", expr="o_totalprice > 450000 AND prio = '5-LOW'", label="dear but low"),
        Rule("sql", expr="prio = NULL"),
    )


@query(
    "h12_row_count",
    "SELECT 0::BIGINT AS rule_no, 'pass' AS status, 0::BIGINT AS violations, count(*) AS actual FROM orders "
    "UNION ALL SELECT 1, 'warn', 1, count(*) FROM orders",
)
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    report = validate(
        load(spark, folder, "orders"),
        [Rule("row_count", min=10), Rule("row_count", max=5, severity="warning")],
    )
    return report.select("rule_no", "status", "violations", "actual")


RULESET = {
    "version": 1,
    "source": "orders",
    "rules": [
        {"col": "prio", "type": "not_null", "severity": "error"},
        {"col": "o_totalprice", "type": "range", "min": 2000, "max": 480000},
        {"cols": ["cust", "o_orderdate"], "type": "unique"},
        {"col": "prio", "type": "allowed", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM"],
         "severity": "warning"},
        {"col": "cust", "type": "reference", "refFrom": "customer", "refCol": "c_custkey"},
        {"type": "sql", "expr": "o_orderstatus = 'P' AND o_totalprice < 20000", "label": "cheap"},
        {"type": "row_count", "min": 1},
        {"col": "o_orderpriority", "type": "pattern", "mode": "compact"},
    ],
}

_CONDITIONS = (
    ("prio IS NULL", True),
    ("NOT (o_totalprice >= 2000 AND o_totalprice <= 480000)", True),
    ("(cust, o_orderdate) IN (SELECT (cust, o_orderdate) FROM h WHERE cust IS NOT NULL AND o_orderdate IS "
     "NOT NULL GROUP BY cust, o_orderdate HAVING count(*) > 1)", True),
    ("prio NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", False),
    ("cust IS NOT NULL AND cust NOT IN (SELECT c_custkey FROM customer)", True),
    ("o_orderstatus = 'P' AND o_totalprice < 20000", True),
)


def _validate_sql() -> str:
    any_error = " OR ".join(f"coalesce({c}, false)" for c, error in _CONDITIONS if error)
    sums = ", ".join(f"count(*) FILTER (WHERE {c}) AS v{i}" for i, (c, _) in enumerate(_CONDITIONS))
    rows = [
        f"SELECT {i}::BIGINT AS rule_no, v{i} AS violations, CASE WHEN v{i} = 0 THEN 'pass' ELSE "
        f"'{'fail' if error else 'warn'}' END AS status, round(v{i} / total, 8) AS share, invalid, "
        "total - invalid AS valid, round((total - invalid) / total, 8) AS score FROM s"
        for i, (_, error) in enumerate(_CONDITIONS)
    ]
    rows += [
        f"SELECT {i}::BIGINT, 0::BIGINT, '{status}', 0.0::DOUBLE, invalid, total - invalid, "
        "round((total - invalid) / total, 8) FROM s"
        for i, status in ((6, "pass"), (7, "pass"))
    ]
    return (
        f"WITH h AS (SELECT * FROM {_HOLES}), s AS (SELECT count(*) AS total, count(*) FILTER (WHERE "
        f"{any_error}) AS invalid, {sums} FROM h) " + " UNION ALL ".join(rows)
    )


@query("h13_validate", _validate_sql())
def whole_ruleset(spark: SparkSession, folder: str) -> DataFrame:
    """A ruleset document with every kind of rule, checked in one pass."""
    tables = {"customer": load(spark, folder, "customer")}
    checks = rules.load_rules(json.dumps(RULESET), tables)
    report = validate(holes(spark, folder), checks)
    return report.select(
        "rule_no", "violations", "status", near("share", "share", 8), "invalid", "valid",
        near("score", "score", 8),
    )


@query(
    "h14_violation_sample",
    "(SELECT o_orderkey, 'unique' AS rule FROM " + _HOLES + " WHERE cust IN (SELECT cust FROM " + _HOLES
    + " WHERE cust IS NOT NULL GROUP BY 1 HAVING count(*) > 1) ORDER BY 1 LIMIT 20) UNION ALL "
    "(SELECT o_orderkey, 'range' FROM orders WHERE o_totalprice > 450000 ORDER BY 1 LIMIT 20)",
)
def violation_sample(spark: SparkSession, folder: str) -> DataFrame:
    df = holes(spark, folder)
    first = rules.sample_violations(df, Rule("unique", "cust"), 20, ["o_orderkey"])
    second = rules.sample_violations(df, Rule("range", "o_totalprice", max=450000), 20, ["o_orderkey"])
    return first.select("o_orderkey", F.lit("unique").alias("rule")).unionAll(
        second.select("o_orderkey", F.lit("range").alias("rule"))
    )


@query(
    "h15_suggest",
    "SELECT 'c_custkey' AS \"column\", 'not_null' AS type, '' AS detail FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 'c_custkey', 'unique', '' FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 'c_custkey', 'range', min(c_custkey) || ' ' || max(c_custkey) FROM customer UNION ALL "
    "SELECT 'c_name', 'not_null', '' FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 'c_name', 'unique', '' FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 'c_name', 'pattern', string_agg(DISTINCT regexp_replace(regexp_replace(regexp_replace(c_name, "
    "'[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g'), ' ') FROM customer UNION ALL "
    "SELECT 'c_mktsegment', 'not_null', '' FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 'c_mktsegment', 'allowed', (SELECT string_agg(s, ' ' ORDER BY s) FROM (SELECT DISTINCT "
    "c_mktsegment AS s FROM customer)) FROM (SELECT 1 FROM customer LIMIT 1)",
)
def suggest(spark: SparkSession, folder: str) -> DataFrame:
    customer = load(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = []
    for r in rules.suggest(customer):
        detail = ""
        if r.type == "range":
            detail = f"{int(r.min)} {int(r.max)}"
        elif r.type in ("allowed", "pattern"):
            detail = " ".join(r.values or r.masks)
        rows.append((r.col, r.type, detail))
    return spark.createDataFrame(rows, "column string, type string, detail string")


@query(
    "h13_report",
    "WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS high, (SELECT coalesce(sum(k), 0) "
    "FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS twice FROM orders) "
    "SELECT unnest(range(1, 12)) AS line_no, unnest(['# Validation report', '', '- Rows: ' || n, "
    "'- Score: ' || printf('%.1f', 100.0 * (n - high) / n) || ' % · ' || (n - high) || '/' || n || ' valid · ' || "
    "high || ' with violations', '', '| Rule | Status | Violations |', '|---|---|---|', "
    "'| not_null `o_orderkey` | ✓ | 0 |', "
    "'| unique `o_custkey` | ' || CASE WHEN twice > 0 THEN '⚠' ELSE '✓' END || ' | ' || twice || ' |', "
    "'| range `total \\| price` | ' || CASE WHEN high > 0 THEN '✗' ELSE '✓' END || ' | ' || high || ' |', "
    "'| row_count | ✓ | ' || n || ' |']) AS value FROM c",
)
def report(spark: SparkSession, folder: str) -> DataFrame:
    """The report as a text: figures of the table, a line per rule."""
    checks = [
        Rule("not_null", "o_orderkey"),
        Rule("unique", "o_custkey", severity="warning"),
        Rule("range", "o_totalprice", max=300_000, label="total | price"),
        Rule("row_count", min=1),
    ]
    return rules.report_document(rules.validate(load(spark, folder, "orders"), checks))
