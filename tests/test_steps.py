import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.functions import casts
from tablewright.operators import impact, scan, steps as S
from tablewright.plans import protection
from tablewright.plans.pipeline import Entry, Pipeline


def one(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def values(df):
    return [r.x for r in df.collect()]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("1.5", 2), ("2.5", 3), ("-2.5", -3), ("1e3", 1000), ("12abc", None), ("", None), (" 1 ", 1),
     ("9999999999999999999", None)],
)
def test_text_to_whole_number(spark, value, expected):
    assert values(Pipeline([S.Cast("x", "BIGINT")]).apply(one(spark, [value]))) == [expected]


def test_double_to_whole_number_is_half_even(spark):
    df = one(spark, [2.5, 3.5, -2.5], "double")
    assert values(Pipeline([S.Cast("x", "BIGINT")]).apply(df)) == [2, 4, -2]


def test_other_casts(spark):
    out = lambda t, v: values(Pipeline([S.Cast("x", t)]).apply(one(spark, [v])))[0]
    assert out("BOOLEAN", "yes") is True and out("BOOLEAN", "on") is None
    assert out("DATE", "2024-1-5") == datetime.date(2024, 1, 5) and out("DATE", "2024") is None
    assert out("DOUBLE", "1d") is None and out("DOUBLE", "1e3") == 1000.0
    assert out("TIME", "9:05:01") == "09:05:01" and out("TIME", "late") is None


def test_date_patterns(spark):
    assert casts.java_pattern("DD.MM.YYYY HH:mm") == "d.M.yyyy H:m"
    assert casts.pattern_list("%d.%m.%Y; MM/DD/YY") == ["d.M.yyyy", "M/d/yy"]
    df = one(spark, ["5.3.2024", "03/07/24", "07.08.75", "x"])
    step = S.Cast("x", "DATE", "DD.MM.YYYY,MM/DD/YY,DD.MM.YY")
    got = values(Pipeline([step]).apply(df))
    d = datetime.date
    assert got == [d(2024, 3, 5), d(2024, 3, 7), d(1975, 8, 7), None]


def test_regex_steps(spark):
    df = one(spark, ["a1b2$", None])
    run = lambda s: values(Pipeline([s]).apply(df))
    assert run(S.RegexReplace("x", r"(\d)", r"<\1>")) == ["a<1>b<2>$", None]
    assert run(S.RegexReplace("x", r"([A-Z])(\d)", r"\2\1\0", False, True)) == ["1aa1b2$", None]
    assert run(S.RegexReplace("x", r"\$", "$1")) == ["a1b2$1", None]
    assert run(S.RegexExtract("x", r"b(\d)", 1)) == ["2", None]
    assert run(S.RegexExtract("x", "q")) == [None, None]


def test_disabled_and_incomplete_steps(spark):
    plan = Pipeline([Entry(S.Case("x"), enabled=False), S.RegexReplace("x", ""), S.Trim("x")])
    assert values(plan.apply(one(spark, [" a  b "]))) == ["a b"]
    assert plan.signature() == Pipeline([S.Trim("x")]).signature()


def test_dedup_keys_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, 4)], "k int, v int")
    out = Pipeline([S.DedupKeys(("k",), "last", "v")]).apply(df)
    assert sorted(r.v for r in out.collect()) == [2, 4]


def test_coarsen_keeps_sums_with_copies(spark):
    """Equal rows without a key: exactly one of them takes the difference."""
    df = spark.createDataFrame([("a", 149.0)] * 5 + [("b", 51.0), ("b", None)], "g string, x double")
    out = Pipeline([S.Coarsen("x", 100, "g")]).apply(df)
    rows = sorted((r.g, r.x if r.x is not None else -1) for r in out.collect())
    assert rows == [("a", 100.0)] * 4 + [("a", 345.0), ("b", -1), ("b", 51.0)]


def test_running_balance_with_copies(spark):
    df = spark.createDataFrame([(1, 5.0)] * 3 + [(0, 1.5), (2, -0.5)], "d int, x double")
    out = Pipeline([S.RecalcBalance("s", "x", "d", opening=10)]).apply(df)
    assert sorted((r.d, r.s) for r in out.collect()) == [
        (0, 11.5), (1, 16.5), (1, 21.5), (1, 26.5), (2, 26.0),
    ]


def test_pseudonyms(spark):
    df = one(spark, ["Acme GmbH"] * 6 + ["Finanzamt Nord"] * 6 + ["Jo"] * 6 + ["Rare"] + [None])
    out = Pipeline([S.Synth("x", "autoEntity", keep_authorities=True)], salt="s").apply(df)
    counts = {r.x: r["count"] for r in out.groupBy("x").count().collect()}
    assert counts["Finanzamt Nord"] == 6 and counts["Weitere Personen (Sammel)"] == 1
    assert counts[None] == 1 and sorted(counts.values()) == [1, 1, 6, 6, 6]
    assert "Acme GmbH" not in counts and "Jo" not in counts


def test_random_steps_then_wide_steps(spark):
    """Drawn values are written out before a step that reads them twice."""
    df = spark.range(200).select(F.col("id").cast("string").alias("x"), "id")
    plan = Pipeline(
        [S.Synth("x", "city", "rand"), S.Synth("x", "autoEntity", "consistent", k=0)], seed=5
    )
    out = plan.apply(df)
    assert out.where("x IS NULL").count() == 0 and out.count() == 200


def test_shuffle_rows_keeps_nulls(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("x"))
    out = Pipeline([S.Shuffle("x", "rand")], seed=1).apply(df)
    assert out.count() == 300 and out.where("x IS NULL").count() == 100
    assert out.where("x IS NOT NULL AND NOT x BETWEEN 0 AND 6").count() == 0


def pii(spark):
    first = ["Anna", "Bob", "Carol", "Dora", "Emil", "Fritz", "Gina", "Hugo", "Ida", "Jan"]
    last = ["Berger", "Klein", "Ritter", "Falk", "Adler", "Braun", "Conrad", "Dorn", "Ernst", "Fuchs"]
    rows = []
    for i in range(60):
        f, n = first[i % 10], last[(3 * i) % 10]
        number = 1000000 + 7919 * i
        rows.append((
            f"{f} {n}", f"{f}.{n}@example.com".lower(), f"+49 89 {str(number)[:3]} {str(number)[3:]}",
            f"DE{10 + i}{number:015d}", "DEUTDEFFXXX", ["80331", "10115", "20095", "50667", "01067"][i % 5],
            f"{1960 + i % 40}-{i % 12 + 1:02d}-01", (100 + 37.5 * i) * (-1 if i % 2 == 0 else 1),
            ["Miete", "Gehalt", "Versicherung", "Einkauf", "Reise"][i % 5],
        ))
    names = "kunde string, email string, telefon string, iban string, bic string, plz string, " \
            "geburtsdatum string, betrag double, kategorie string"
    return spark.createDataFrame(rows, names)


def test_pii_scan(spark):
    found = {r.column: (r.type, r.via) for r in scan.scan_pii(pii(spark)).collect()}
    assert found == {
        "kunde": ("personname", "name"), "email": ("email", "content"), "telefon": ("phone", "content"),
        "iban": ("iban", "content"), "bic": ("bic", "content"), "plz": ("zip", "name"),
        "geburtsdatum": ("birthdate", "name"),
    }


@pytest.mark.parametrize(
    ("kind", "name"),
    [("email", "email"), ("email", "E-Mail"), ("iban", "iban"), ("iban", "kontonummer"), ("bic", "BIC"),
     ("bic", "swift"), ("phone", "telefon"), ("zip", "plz")],
)
def test_pii_names(kind, name):
    assert scan.pii_type_by_name(name) == kind


@pytest.mark.parametrize(
    ("kind", "value", "hit"),
    [("email", "anna.berger@example.com", True), ("email", "not an email", False),
     ("iban", "DE44500105175407324931", True), ("bic", "DEUTDEFFXXX", True), ("iban", "DEUTDEFFXXX", False),
     ("phone", "+49 89 1234567", True), ("phone", "2024-01-15", False), ("phone", "089/12345", True),
     ("creditcard", "4111 1111 1111 1111", True), ("creditcard", "4111 1111 1111 1112", False),
     ("ip", "192.168.0.255", True), ("ip", "192.168.0.256", False)],
)
def test_pii_content(spark, kind, value, hit):
    assert one(spark, [value]).select(scan.content_test(kind, "x")).first()[0] is hit


def test_levels(spark):
    df = pii(spark)
    found = protection.scan(df)
    level1 = protection.anonymise(df, 1, "s", findings=found)
    assert level1.columns == df.columns and level1.count() == 60
    before, after = df.collect(), level1.collect()
    assert not {r.email for r in before} & {r.email for r in after}
    assert sorted(r.plz for r in before) == sorted(r.plz for r in after)
    kinds = lambda n: {s.column: s.kind for s in protection.plan(df, n, found) if s.anonymises}
    assert kinds(1) == {"kunde": "synth", "email": "synth", "telefon": "synth", "iban": "synth", "bic": "synth"}
    assert kinds(2)["betrag"] == "numNoise" and kinds(2)["plz"] == "synth"
    assert kinds(3)["betrag"] == "numRandom"
    level3 = protection.anonymise(df, 3, "s", 1, found).collect()
    lo, hi = min(r.betrag for r in before), max(r.betrag for r in before)
    assert all(lo <= r.betrag <= hi for r in level3)


def test_switching_levels_keeps_own_steps(spark):
    df = pii(spark)
    found = protection.scan(df)
    first = protection.plan(df, 1, found)
    mine = Pipeline([S.Trim("kategorie"), *first])
    second = protection.apply_level(mine, first, df, 2, found)
    kinds = [e.step.kind for e in second.entries]
    assert kinds[0] == "trim" and kinds.count("numNoise") == 1
    assert sum(e.step.kind == "synth" for e in second.entries) == 6


def test_impacts_in_one_pass_match_single_ones(spark):
    df = spark.range(50).select(
        F.when(F.col("id") % 5 > 0, F.concat(F.lit(" "), "id", F.when(F.col("id") % 7 == 0, "x").otherwise("")))
        .alias("x"),
        (F.col("id") % 3).alias("g"),
    )
    plan = Pipeline([S.Trim("x"), S.Cast("x", "BIGINT"), S.DedupExact(), S.Hash("x"), S.Coarsen("x", 2, "g")])
    together = [tuple(r) for r in impact.impacts(plan, df).orderBy("step_no").collect()]
    single = [tuple(impact.impact(plan, df, i).first()) for i in range(5)]
    assert together == single


RANDOM_STEPS = [S.Synth("name", "email", "rand"), S.NumNoise("x", 0.1, "rand", relative=True),
                S.NumRandom("y", 0, 9), S.Shuffle("city", "rand"), S.Shuffle("name2", "rand")]


@pytest.mark.parametrize("key", [(), ("id",)])
def test_random_draws_do_not_depend_on_partitions(spark, key):
    """2 and 64 partitions draw alike, copies of a row draw apart, another seed draws anew."""
    rows = [(i, f"n{i % 7}", f"m{i % 5}", float(i % 3), 1.0, f"c{i % 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, name2 string, x double, y double, city string")
    if not key:
        df = df.drop("id")

    def drawn(parts, seed=4):
        return sorted(map(tuple, Pipeline(RANDOM_STEPS, seed=seed, key=key).apply(df.repartition(parts)).collect()))

    two = drawn(2)
    assert two == drawn(64) and two != drawn(2, seed=5) and len(two) == 300
    assert len({r[-2] for r in two}) > 100  # values of y, though all rows with one content are copies


def test_random_steps_between_others(spark):
    rows = [(1, "a", 5.0), (1, "a", 5.0), (2, "b", 6.0)]
    df = spark.createDataFrame(rows, "id long, name string, x double")
    out = Pipeline([S.NumRandom("x", 0, 1), S.DedupExact(), S.NumRandom("x", 10, 11)], seed=1).apply(df)
    assert out.columns == ["id", "name", "x"] and out.count() == 3
    assert out.where("x NOT BETWEEN 10 AND 11").isEmpty()


def test_random_draws_fill_the_range(spark):
    df = spark.range(4000).select(F.col("id"), F.lit(1.0).alias("x"))
    out = Pipeline([S.NumRandom("x", -100, 300)], seed=2, key=("id",)).apply(df)
    low, high, mean = out.agg(F.min("x"), F.max("x"), F.avg("x")).first()
    assert -100 <= low < -99 and 299 < high <= 300 and 94 < mean < 106


def test_labels_beyond_five_digits(spark, tmp_path):
    """100,001 customers: the query cuts as its SQL does, the operator's labels stay apart."""
    from compare import connect
    from table_queries import ORACLES, QUERIES
    from tablewright.operators import synth

    n = 100_001
    spark.range(n).select(F.concat(F.lit("c"), "id").alias("c_name")).coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet"))
    got = QUERIES["d14_label_generators"](spark, str(tmp_path)).toPandas()
    con = connect(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    columns = ", ".join(got.columns)
    con.register("got", got)
    wanted = f"SELECT {columns} FROM ({ORACLES['d14_label_generators']})"
    assert con.execute(f"SELECT count(*) FROM ({wanted} EXCEPT ALL SELECT {columns} FROM got)").fetchone() == (0,)
    assert len(got) == n
    ranks = spark.range(1, n + 1).select(synth.structured_label("zip", F.col("id")).alias("z"))
    assert ranks.distinct().count() == n
