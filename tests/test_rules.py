from pyspark.sql import functions as F

from tablewright.operators import rules
from tablewright.operators.rules import Rule, validate


def table(spark):
    rows = [
        (1, "a@b.com", "DE-12", 10, "ok"),
        (2, "b@c.com", "DE-34", 20, "ok"),
        (3, "bad", "DE-56", 30, " spaced"),
        (4, None, "XX-9", 999, "ok"),
        (5, "d@e.com", "DE-78", 20, "ok"),
    ]
    return spark.createDataFrame(rows, "id int, email string, code string, amount int, note string")


CHECKS = [
    Rule("not_null", "email"),
    Rule("regex", "email", pattern=r"^[^@]+@[^@]+\.[^@]+$"),
    Rule("range", "amount", min=1, max=100),
    Rule("unique", "amount"),
    Rule("trimmed", "note"),
    Rule("length", "code", min=2, max=5),
    Rule("sql", expr="amount < 0"),
    Rule("row_count", min=3),
]


def test_counts_per_rule_and_invalid_rows(spark):
    report = validate(table(spark), CHECKS).orderBy("rule_no").collect()
    assert [r.violations for r in report] == [1, 1, 1, 2, 1, 0, 0, 0]
    first = report[0]
    assert (first.total, first.invalid, first.valid, first.ok) == (5, 4, 1, False)
    assert [report[i].status for i in (5, 7)] == ["pass", "pass"]
    assert report[7].actual == 5


def test_two_key_rules_at_once(spark):
    """One key rule is folded into the pass, the other joined; both count the same."""
    df = table(spark)
    both = [Rule("unique", "amount"), Rule("unique", cols=("note", "amount")), Rule("not_null", "email")]
    for order in (both, both[::-1]):
        report = validate(df, order).collect()
        assert sorted((r.type, r.violations) for r in report) == [
            ("not_null", 1), ("unique", 2), ("unique", 2),
        ]
        assert report[0].invalid == 3


def test_warning_keeps_run_ok(spark):
    report = validate(table(spark), [Rule("range", "amount", min=1, max=100, severity="warning")])
    row = report.first()
    assert (row.status, row.ok, row.invalid) == ("warn", True, 0)


def test_numeric_range_on_text(spark):
    df = spark.createDataFrame([("1",), ("5",), ("20",), (None,)], "id string")
    assert validate(df, [Rule("range", "id", min=2, max=10)]).first().violations == 2


def pattern_table(spark):
    return spark.createDataFrame([(f"DE-{10 + i}",) for i in range(19)] + [("junk",)], "code string")


def test_pattern_rule(spark):
    df = pattern_table(spark)
    row = validate(df, [Rule("pattern", "code")]).first()
    assert (row.status, row.violations) == ("fail", 1)
    assert rules.resolve(df, Rule("pattern", "code")).masks == ("AA-99",)


def test_pattern_without_dominant_mask_is_skipped(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("dddd",)], "t string")
    row = validate(df, [Rule("pattern", "t")]).first()
    assert (row.status, row.violations, row.ok) == ("skipped", 0, True)


def test_reference_rule_and_null_in_the_list(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "fk int")
    known = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    gaps = spark.createDataFrame([(1,), (None,)], "id int")
    assert validate(df, [Rule("reference", "fk", ref=known, ref_col="id")]).first().violations == 1
    assert validate(df, [Rule("reference", "fk", ref=gaps, ref_col="id")]).first().violations == 0
    both = [Rule("reference", "fk", ref=known, ref_col="id"), Rule("unique", "fk")]
    assert [r.violations for r in validate(df, both).orderBy("rule_no").collect()] == [1, 0]


def test_sample(spark):
    rows = rules.sample_violations(table(spark), Rule("range", "amount", min=1, max=100)).collect()
    assert [r.amount for r in rows] == [999]
    rows = rules.sample_violations(table(spark), Rule("unique", "amount"), 20, ["id"]).collect()
    assert [r.id for r in rows] == [2, 5]


def test_suggest(spark):
    rows = [(1, "aktiv"), (2, "aktiv"), (3, "gesperrt"), (4, "aktiv"), (5, "gesperrt")]
    df = spark.createDataFrame(rows, "id int, status string")
    found = {(r.col, r.type) for r in rules.suggest(df)}
    assert {("id", "not_null"), ("id", "unique"), ("status", "allowed")} <= found
    report = validate(df, rules.suggest(df)).collect()
    assert all(r.status in ("pass", "skipped") for r in report)


def test_ruleset_document_round_trip(spark):
    text = rules.dump_rules(CHECKS, "v")
    again = rules.load_rules(text)
    assert [(r.type, r.col, r.min, r.max, r.pattern) for r in again] == [
        (r.type, r.col, r.min, r.max, r.pattern) for r in CHECKS
    ]
    assert len(rules.load_rules('[{"type": "not_null", "col": "a"}]')) == 1


def test_empty_table(spark):
    df = table(spark).limit(0)
    row = validate(df, [Rule("unique", "amount"), Rule("not_null", "id")]).first()
    assert (row.total, row.invalid, row.score, row.ok) == (0, 0, 1.0, True)


def test_key_rules_share_lookups(spark):
    """Four unique and two reference rules over two key columns: two lookups, figures as one by one."""
    rows = [(i % 40 if i % 9 else None, i % 70, f"n{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c string")
    known = spark.range(30).select(F.col("id").alias("k"))
    listed = [
        Rule("unique", "a"), Rule("unique", "b"), Rule("reference", "a", ref=known, ref_col="k"),
        Rule("unique", "a", severity="warning"), Rule("reference", "b", ref=known, ref_col="k"),
        Rule("unique", "b", severity="warning"),
    ]
    flagged = rules.flag_rules(df, listed)
    for i, rule in enumerate(listed):
        assert flagged.where(f"_r{i}").count() == rules.violating_rows(df, rule).count()
    assert flagged.columns == ["a", "b", "c"] + [f"_r{i}" for i in (0, 2, 3, 1, 4, 5)]
    report = {r.rule_no: r for r in validate(df, listed).collect()}
    for i, rule in enumerate(listed):
        alone = validate(df, [rule]).first()
        assert report[i].violations == alone.violations and report[i].status == alone.status
    hurt = flagged.where("_r0 OR _r1 OR _r2 OR _r4").count()
    assert report[0].invalid == hurt


def test_table_is_joined_once_per_key_set(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("b"))
    listed = [Rule("unique", "id"), Rule("unique", "b"), Rule("unique", "id", severity="warning"),
              Rule("unique", "b", severity="warning")]
    plan = rules.flag_rules(df, listed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 4  # a broadcast of hot keys and a salted join, for each set
