"""Quality scan, personal-data scan and column figures for anonymising.

Each scan reads the whole table in one aggregate (plus a duplicate count and
distinct counts); only the vote counts reach the driver.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions.casts import TARGET_TYPES, parse_number
from tablewright.functions.columns import any_of, categories, col, number_of, text_of
from tablewright.operators import steps as S
from tablewright.operators.distributed import exact_quantiles, spread_rows

WHOLE_TABLE = "(all rows)"

# ---------------------------------------------------------------- matchers

# How dates are written, whole cell.
DATE_LIKE = (
    r"\A\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?\z",
    r"\A\d{1,2}\.\d{1,2}\.\d{2,4}\z",
    r"\A\d{1,2}/\d{1,2}/\d{2,4}\z",
)
# Words that stand for true or false; 0 and 1 count beside one of them.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "ja", "nein", "t", "f")
# Column names whose digits are codes, not amounts.
CODE_NAME = (
    r"(?:^id$|_id$|\bid\b|\bnr\b|nummer|\bno\b|_no$|code|plz|zip|postal|iban|\bbic\b|konto"
    r"|account|\btel\b|phone|telefon|fon|mobil|ausweis|steuer)"
)


NUMBER_SHAPE = r"\A[-+]?[\d.,']*\d[\d.,']*\z"


def looks_date(text: Column) -> Column:
    return any_of([text.rlike(p) for p in DATE_LIKE])


def _bare_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s€$£%]", "")


def looks_numeric(text: Column) -> Column:
    return ~looks_date(text) & _bare_number(text).rlike(NUMBER_SHAPE)


def needs_trim(text: Column) -> Column:
    return text.rlike(r"\A\s|\s\z|\s{2,}|[\t\n\x0B\f\r]")


def _comma_votes(text: Column) -> tuple[Column, Column]:
    """(last separator is a comma, last separator is a point)."""
    bare = _bare_number(text)
    return bare.rlike(r",[^.,]*\z"), bare.rlike(r"\.[^.,]*\z")


def decimal_sign(text: Column) -> Column:
    """Aggregate: the decimal sign most values use; a comma on a tie."""
    comma, point = _comma_votes(text)
    return F.when(F.count_if(comma) >= F.count_if(point), ",").otherwise(".")


_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"

# SQL tests for personal data that shows in the cell itself, in the order they are
# tried; {t} is the trimmed text.  Dates are no phone numbers; card numbers need a good check sum.
CONTENT_TESTS = {
    "email": r"{t} RLIKE r'\A[^\s@]+@[^\s@]+\.[A-Za-z]{{2,}}\z'",
    "bic": r"{t} RLIKE r'\A[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?\z'",
    "iban": r"upper(regexp_replace({t}, r'\s+', '')) RLIKE r'\A[A-Z]{{2}}\d{{2}}[A-Z0-9]{{10,30}}\z'",
    "phone": (
        r"NOT {t} RLIKE r'\A\d{{4}}-\d{{1,2}}-\d{{1,2}}([ T]\d{{1,2}}:\d{{2}}.*)?\z' "
        r"AND NOT {t} RLIKE r'\A\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}\z' "
        r"AND NOT {t} RLIKE r'\A\d{{4}}[./]\d{{1,2}}[./]\d{{1,2}}\z' "
        r"AND {t} RLIKE r'\A[+(]?\d[\d\s()/.\-]{{6,}}\z' AND {t} RLIKE r'[+()/\-\s]|\A0' "
        r"AND char_length(regexp_replace({t}, r'\D', '')) BETWEEN 7 AND 15"
    ),
    "creditcard": (
        r"CASE WHEN regexp_replace({t}, r'[\s\-]', '') RLIKE r'\A\d{{13,19}}\z' THEN "
        r"aggregate(transform(split(reverse(regexp_replace({t}, r'[\s\-]', '')), ''), "
        r"(c, i) -> CAST(c AS INT) * (1 + i % 2)), 0, "
        r"(sum, n) -> sum + IF(n > 9, n - 9, n)) % 10 = 0 ELSE false END"
    ),
    "uuid": r"{t} RLIKE r'(?i)\A[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}\z'",
    "ip": r"{t} RLIKE r'\A" + _OCTET.replace("{", "{{").replace("}", "}}") + r"(\."
    + _OCTET.replace("{", "{{").replace("}", "}}") + r"){{3}}\z'",
}


def content_test(key: str, column: str) -> Column:
    """Does the text in `column` look like this type of personal data?"""
    return F.expr(CONTENT_TESTS[key].format(t=f"`{column}`"))


# Personal-data types in the order they are tried, their level of
# protection, and the column names that point to them.
PII_TYPES = (
    ("email", "direct", r"e[\W_]?mail"),
    ("bic", "direct", r"\bbic\b|\bswift\b|\bbank[\W_]?code\b"),
    ("iban", "direct", r"\biban\b|kontonummer|konto[\W_]?nr|account[\W_]?(no|number|nr)"),
    ("phone", "direct", r"telefon|\btel\b|\bfon\b|phone|mobil|handy|\bfax\b"),
    ("creditcard", "direct", r"kreditkart|credit[\W_]?card|card[\W_]?(no|number)|kartennummer"),
    ("uuid", "direct", r"\buuid\b|\bguid\b"),
    ("ip", "quasi", r"\bip[\W_]?(addr|adresse|address)?\b"),
    (
        "partyname",
        "direct",
        r"beg[uü]nstigt|empf[aä]nger|zahlungspflicht|\bpartner\b|inhaber|kontoinhaber|holder"
        r"|lieferant|vendor|supplier|debitor|kreditor",
    ),
    (
        "personname",
        "direct",
        r"(vor|nach|nick|spitz|familien)[\W_]?name|first[\W_]?name|last[\W_]?name|sur[\W_]?name"
        r"|full[\W_]?name|name\b|kunde|customer[\W_]?name|ansprechpartner|kontaktperson",
    ),
    (
        "govid",
        "direct",
        r"\bssn\b|sozialvers|steuer[\W_]?(id|nr|nummer)|tax[\W_]?id|\bvat\b|ust[\W_]?id"
        r"|personalausweis|\bausweis\b|reisepass|passport|\bnino\b",
    ),
    ("address", "direct", r"stra(ss|ß)e\b|\bstreet\b|adresse|address|anschrift|hausnummer"),
    (
        "customerid",
        "direct",
        r"^id$|kunden[\W_]?(id|nummer|nr)|customer[\W_]?(id|no|number)|personal[\W_]?nr"
        r"|mitarbeiter[\W_]?(id|nr)|user[\W_]?id|benutzer[\W_]?id|patient[\W_]?(id|nr)",
    ),
    (
        "birthdate",
        "quasi",
        r"geb(urts)?[\W_]?(datum|tag)?|\bdob\b|date[\W_]?of[\W_]?birth|birth[\W_]?date|geboren",
    ),
    ("zip", "quasi", r"\bplz\b|postleitzahl|\bzip\b|postal[\W_]?code"),
    ("city", "quasi", r"\bort\b|wohnort|\bstadt\b|\bcity\b|gemeinde|\btown\b"),
    ("gender", "quasi", r"geschlecht|gender|\bsex\b|anrede|salutation"),
    ("age", "quasi", r"\balter\b|\bage\b|jahrgang"),
    (
        "nationality",
        "quasi",
        r"nationalit|staatsang|staatsb[uü]rger|\bcountry\b|herkunft|ethni",
    ),
    ("marital", "quasi", r"familienstand|marital"),
    (
        "health",
        "sensitive",
        r"diagnos|krankheit|\bkrank\b|health|gesundheit|medik|behandlung|\bicd\b|allerg|disab"
        r"|behinder|\bpfleg",
    ),
    ("religion", "sensitive", r"religion|konfession|glaube"),
    ("political", "sensitive", r"\bpartei\b|politic|gewerkschaft"),
    ("income", "sensitive", r"gehalt|salary|einkommen|income|\blohn\b|verdienst|bonus"),
)
PII_LEVEL = {key: level for key, level, _ in PII_TYPES}


def pii_type_by_name(name: str) -> str | None:
    """First type whose name pattern fits a column name."""
    for key, _, pattern in PII_TYPES:
        if re.search(pattern, name.lower(), re.IGNORECASE | re.ASCII):
            return key
    return None


# ---------------------------------------------------------------- quality scan


@dataclass(frozen=True)
class Suggestion:
    """A cleaning step the data asks for."""

    target: str
    step: S.Step
    reason: str
    confidence: str
    order: int

    @property
    def kind(self) -> str:
        return self.step.kind


def suggestion_frame(spark: SparkSession, suggestions: list[Suggestion]) -> DataFrame:
    """(target, kind, params, reason, confidence, position)."""
    rows = [
        (s.target, s.kind, json.dumps(asdict(s.step), sort_keys=True), s.reason, s.confidence, s.order)
        for s in suggestions
    ]
    schema = "target string, kind string, params string, reason string, confidence string, position bigint"
    return spark.createDataFrame(rows, schema)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicates): rows beyond the first of each group of equal rows."""
    counted = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def clean_votes(df: DataFrame) -> DataFrame:
    """One row per column: how many cells are blank, untrimmed, boolean, dates, numbers.

    Text columns get all votes, other columns the counts of filled cells.
    """
    kinds = categories(df)
    words = ", ".join(f"'{w}'" for w in BOOLEAN_WORDS)
    if not df.columns:
        schema = ", ".join(f"{k} bigint" for k in ("total", *VOTES))
        return df.sparkSession.createDataFrame([], f"column string, category string, {schema}")
    # a row per cell, marks per text cell, then one plain aggregate: compiled once, whatever the columns
    none = F.lit(None).cast("string")
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            (col(n).cast("string") if kinds[n] == "string" else none).alias("t"),
            (F.lit(None).cast("boolean") if kinds[n] == "string" else col(n).isNotNull()).alias("there"),
        )
        for i, n in enumerate(df.columns)
    ]
    rows = spread_rows(df).select(F.inline(F.array(*cells)))
    c, number = F.col("t"), F.col("n")
    digits = c.rlike(r"\d")
    date = digits & looks_date(c)
    sign = F.regexp_extract(number, r"([.,])[^.,]*\z", 1)
    marked = rows.select("i", "t", "there", _bare_number(c).alias("n")).select(
        "i",
        "there",
        c.rlike(r"\S").alias("solid"),
        needs_trim(c).alias("loose"),
        F.lower(F.regexp_replace(c, r"\A\s+|\s+\z", "")).alias("low"),
        F.when(date, S.date_format_of(c)).alias("fmt"),
        F.when(
            digits & ~date & number.rlike(NUMBER_SHAPE),
            F.when(F.regexp_replace(c, r"\s", "").rlike(r"\A[-+]?\d+\z"), "whole")
            .when(sign == ",", "comma")
            .when(sign == ".", "point")
            .otherwise("plain"),
        ).alias("number"),
    )
    votes = {
        "filled": "coalesce(there, solid)",
        "blank": "NOT solid",
        "untrimmed": "solid AND loose",
        "bool_words": f"low IN ({words}, '0', '1')",
        "bool_letters": f"low IN ({words})",
        "dates": "fmt IS NOT NULL",
        **{f"date{j}": f"fmt = '{f}'" for j, (f, _) in enumerate(S.DATE_NOTATIONS)},
        "numbers": "number IS NOT NULL",
        "commas": "number = 'comma'",
        "points": "number = 'point'",
        "wholes": "number = 'whole'",
    }
    counted = marked.groupBy("i").agg(
        F.count(F.lit(1)).alias("total"), *[F.expr(f"count_if({v})").alias(k) for k, v in votes.items()]
    )
    listed = df.sparkSession.createDataFrame(
        [(i, n, kinds[n]) for i, n in enumerate(df.columns)], "_i int, column string, category string"
    )
    found = listed.join(counted, F.col("_i") == F.col("i"), "left").orderBy("_i")
    return found.select(
        "column", "category", *[F.coalesce(col(k), F.lit(0)).cast("bigint").alias(k) for k in ("total", *VOTES)]
    )


VOTES = (
    "filled", "blank", "untrimmed", "bool_words", "bool_letters", "dates",
    *[f"date{j}" for j in range(len(S.DATE_NOTATIONS))],
    "numbers", "commas", "points", "wholes",
)


def scan_clean(df: DataFrame) -> list[Suggestion]:
    """Cleaning steps the table asks for.  Eager: duplicate count and one vote per column."""
    out = []
    if len(df.columns) and "complex" not in categories(df).values():
        copies = duplicate_rows(df).first()[0]
        if copies:
            out.append(
                Suggestion(WHOLE_TABLE, S.DedupExact(), f"{copies} exact duplicate row(s)", "high", 5)
            )
    for v in clean_votes(df).collect():
        name, n = v["column"], max(1, v["filled"])

        def add(step: S.Step, reason: str, confidence: str, order: int) -> None:
            out.append(Suggestion(name, step, reason, confidence, order))

        if v["total"] >= 5 and v["filled"] == 0:
            add(S.Drop(name), "column is entirely null / empty", "high", 6)
            continue
        if v["category"] != "string":
            continue
        if v["blank"] >= 2 and v["filled"]:
            add(S.EmptyToNull(name), f"{v['blank']} empty cell(s)", "medium", 2)
        if v["untrimmed"] >= 2:
            add(S.Trim(name), f"{v['untrimmed']} cell(s) with stray blanks", "medium", 1)
        if v["bool_words"] == v["filled"] and v["bool_letters"]:
            add(S.Cast(name, "BOOLEAN"), "values look boolean", "high", 3)
            continue
        share = v["dates"] / n
        if share >= 0.7:
            counts = [(v[f"date{j}"], f) for j, (f, _) in enumerate(S.DATE_NOTATIONS)]
            formats = [f for c, f in sorted(counts, key=lambda x: -x[0]) if c / v["dates"] >= 0.1]
            target = "TIMESTAMP" if any("HH" in f for f in formats) else "DATE"
            sure = "high" if share >= 0.9 else "medium"
            reason = f"{_percent(share)}% look like dates ({', '.join(formats)})"
            add(S.ParseDate(name, target, tuple(formats)), reason, sure, 3)
            continue
        share = v["numbers"] / n
        if share >= 0.7 and not re.search(CODE_NAME, name, re.IGNORECASE | re.ASCII):
            sign = "," if v["commas"] >= v["points"] else "."
            target = "BIGINT" if v["wholes"] == v["numbers"] else "DOUBLE"
            sure = "high" if share >= 0.9 else "medium"
            add(S.ParseNumber(name, sign, target), f"{_percent(share)}% look numeric", sure, 3)
    return out


def _percent(share: float) -> int:
    return math.floor(share * 100 + 0.5)


# ---------------------------------------------------------------- personal data

PII_SHARE = 0.6
PII_MIN_VALUES = 5


def pii_votes(df: DataFrame) -> DataFrame:
    """(column, values, email, bic, ...): matching cells per column, from one pass."""
    names = [n for n, k in categories(df).items() if k != "complex"]
    if not names:
        counts = ", ".join(f"`{k}` bigint" for k in ["values", *CONTENT_TESTS])
        return df.sparkSession.createDataFrame([], f"column string, {counts}")
    texts = spread_rows(df).select(
        *[
            F.regexp_replace(text_of(df, n), r"\A\s+|\s+\z", "").alias(f"t{i}")
            for i, n in enumerate(names)
        ]
    )
    # a row per cell, so that the tests are compiled once and not once per column
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"t{i}").alias("t")) for i in range(len(names))])
    aggs = [F.count_if(F.col("t") != "").alias("values")]
    aggs += [
        F.expr(f"count_if(t <> '' AND ({test.format(t='t')}))").alias(key)
        for key, test in CONTENT_TESTS.items()
    ]
    counted = texts.select(F.inline(cells)).groupBy("i").agg(*aggs)
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "_i int, column string")
    found = listed.join(counted, F.col("_i") == F.col("i"), "left")
    return found.select(
        "column", *[F.coalesce(col(k), F.lit(0)).cast("bigint").alias(k) for k in ["values", *CONTENT_TESTS]]
    )


def scan_pii(df: DataFrame) -> DataFrame:
    """(column, type, level, via, confidence): by content where 60 % of at least 5 cells match,
    else by column name."""
    votes = pii_votes(df)
    shares = [
        F.struct(
            (F.col(k) / F.col("values")).alias("share"),
            F.lit(-i).alias("rank"),
            F.lit(k).alias("type"),
        )
        for i, k in enumerate(CONTENT_TESTS)
    ]
    best = F.array_max(F.array(*shares))
    hit = (F.col("values") >= PII_MIN_VALUES) & (best["share"] >= PII_SHARE)
    by_name = F.lit(None).cast("string")
    for n in df.columns:
        key = pii_type_by_name(n)
        if key:
            by_name = F.when(F.col("column") == n, key).otherwise(by_name)
    level = F.lit(None).cast("string")
    for key, value in PII_LEVEL.items():
        level = F.when(F.col("type") == key, value).otherwise(level)
    names = df.sparkSession.createDataFrame([(n,) for n in df.columns], "name string")
    found = names.join(votes, F.col("name") == F.col("column"), "left").drop("column")
    found = found.withColumnRenamed("name", "column")
    return (
        found.select(
            "column",
            F.when(hit, best["type"]).otherwise(by_name).alias("type"),
            F.when(hit, "content").otherwise("name").alias("via"),
            F.when(hit, best["share"]).otherwise(F.lit(1.0)).alias("confidence"),
        )
        .where(F.col("type").isNotNull())
        .select("column", "type", level.alias("level"), "via", "confidence")
    )


# ---------------------------------------------------------------- measures and free text


@dataclass(frozen=True)
class Measure:
    """Figures of a numeric column that anonymising needs."""

    min: float
    max: float
    whole: bool
    noise: int
    step: float


@dataclass(frozen=True)
class ColumnMeta:
    measures: dict[str, Measure]
    category: str | None
    free_text: tuple[str, ...]


def anon_meta(df: DataFrame, personal: set[str], suggestions: list[Suggestion] = ()) -> ColumnMeta:
    """Numeric measures, the category column and the free-text columns.

    `personal` columns are left out; text that a parseNumber suggestion reads
    counts as numeric.  Eager: one aggregate, medians and distinct counts.
    """
    from tablewright.operators.profile import distinct_counts

    kinds = categories(df)
    parsed = {s.target: s.step for s in suggestions if isinstance(s.step, S.ParseNumber)}
    numbers: dict[str, tuple[Column, bool]] = {}
    for n in df.columns:
        if n in personal:
            continue
        if n in parsed:
            step = parsed[n]
            value = parse_number(text_of(df, n), step.decimal, step.target).cast("double")
            numbers[n] = (value, TARGET_TYPES[step.target].endswith("int"))
        elif kinds[n] in ("integer", "numeric"):
            numbers[n] = (number_of(df, n), kinds[n] == "integer")
    texts = [n for n in df.columns if kinds[n] == "string" and n not in personal and n not in numbers]

    aggs = [
        f(x).alias(f"{t}{i}")
        for i, (x, _) in enumerate(numbers.values())
        for f, t in ((F.count, "n"), (F.min, "lo"), (F.max, "hi"))
    ]
    solid = {n: F.when(col(n).rlike(r"\S"), col(n)) for n in texts}
    for i, n in enumerate(texts):
        aggs += [F.count(solid[n]).alias(f"t{i}"), F.avg(F.char_length(solid[n])).alias(f"a{i}")]
    if not aggs:
        return ColumnMeta({}, None, ())
    s = df.agg(*aggs).first()
    middles = exact_quantiles(
        df,
        {n: F.abs(x) for n, (x, _) in numbers.items()},
        [0.5],
        {n: s[f"n{i}"] for i, n in enumerate(numbers)},
    )
    measures = {}
    for i, (n, (_, whole)) in enumerate(numbers.items()):
        if s[f"lo{i}"] is None:
            continue
        middle = middles[n][0] or 0.0
        power = max(0, math.floor(math.log10(max(1.0, middle))) - 1)
        noise = max(1, math.floor(middle * 0.15 + 0.5))
        measures[n] = Measure(s[f"lo{i}"], s[f"hi{i}"], whole, noise, max(1.0, 10.0**power))
    category, fewest, free = None, None, []
    if texts:
        counts = distinct_counts(df.select(*[solid[n].alias(n) for n in texts]))
        distinct = {r["column"]: r["distinct"] for r in counts.collect()}
        for i, n in enumerate(texts):
            filled, d = s[f"t{i}"], distinct[n]
            if filled < 5:
                continue
            if 2 <= d <= 25 and d / filled < 0.5 and (fewest is None or d < fewest):
                category, fewest = n, d
            if s[f"a{i}"] >= 20 and d / filled > 0.5:
                free.append(n)
    return ColumnMeta(measures, category, tuple(free))


def meta_frame(df: DataFrame, meta: ColumnMeta) -> DataFrame:
    """(column, role, min, max, noise, step) with role measure, category or free text."""
    rows = [
        (n, "measure", float(m.min), float(m.max), m.noise, m.step) for n, m in meta.measures.items()
    ]
    rows += [(meta.category, "category", None, None, None, None)] if meta.category else []
    rows += [(n, "free text", None, None, None, None) for n in meta.free_text]
    schema = "column string, role string, min double, max double, noise bigint, step double"
    return df.sparkSession.createDataFrame(rows, schema)
