"""Queries over quality scans, personal-data scans and protection levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from table_queries.cleaning import SYNTH_SQL
from table_queries.registry import load, query, sql_list, sql_unit
from tablewright.functions import fixed
from tablewright.operators import scan
from tablewright.operators.steps import Context
from tablewright.plans import protection


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a careless export: dates and amounts as text, blanks, words for true and false."""
    key = F.col("o_orderkey")
    price = F.translate(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), ",.", ".,")
    return load(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 10 == 0, "").otherwise(F.concat("o_orderpriority", F.lit("  x"))).alias("note"),
        F.when(key % 2 == 0, "ja").otherwise("nein").alias("paid"),
        F.when(key % 4 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
        .alias("ordered"),
        F.when(key % 20 == 0, "free").otherwise(price).alias("amount"),
        F.lit(None).cast("string").alias("unused"),
    )


def _percent(share: str) -> str:
    return f"CAST(floor({share} * 100 + 0.5) AS BIGINT)"


@query("i01_duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand FROM part)) "
       "AS duplicates FROM part")
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scan.duplicate_rows(load(spark, folder, "part").select("p_name", "p_brand"))


@query(
    "i02_scan_clean",
    "WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS blank, "
    "count(*) FILTER (WHERE o_orderkey % 20 <> 0) AS numbers FROM orders) "
    "SELECT 'note' AS target, 'emptyToNull' AS kind, blank || ' empty cell(s)' AS reason, 'medium' AS confidence, "
    "2::BIGINT AS position FROM t UNION ALL "
    "SELECT 'note', 'trim', (n - blank) || ' cell(s) with stray blanks', 'medium', 1 FROM t UNION ALL "
    "SELECT 'paid', 'cast', 'values look boolean', 'high', 3 FROM t UNION ALL "
    "SELECT 'ordered', 'parseDate', '100% look like dates (DD.MM.YYYY, MM/DD/YYYY)', 'high', 3 FROM t UNION ALL "
    f"SELECT 'amount', 'parseNumber', {_percent('numbers / n')} || '% look numeric', 'high', 3 FROM t UNION ALL "
    "SELECT 'unused', 'drop', 'column is entirely null / empty', 'high', 6 FROM t",
)
def scan_clean(spark: SparkSession, folder: str) -> DataFrame:
    df = dirty(spark, folder)
    return scan.suggestion_frame(spark, scan.scan_clean(df)).drop("params")


@query(
    "i02_clean_votes",
    "SELECT count(*) AS total, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS filled, "
    "count(*) FILTER (WHERE regexp_matches(text, '\\S') AND text <> regexp_replace(regexp_replace(text, "
    "'^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS untrimmed FROM documents",
)
def clean_votes(spark: SparkSession, folder: str) -> DataFrame:
    votes = scan.clean_votes(load(spark, folder, "documents").select("text"))
    return votes.select("total", "filled", "untrimmed")


def personal(spark: SparkSession, folder: str) -> DataFrame:
    """A customer list with an address, accounts, numbers and codes derived from each row."""
    from tablewright.functions.hashing import draw
    from tablewright.operators import synth

    name = F.col("c_name")
    d = synth.deterministic(name, "pepper")
    code = F.md5(name)
    uuid = F.concat_ws("-", *[F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    ip = F.concat_ws(".", *[draw(name, 300, "", str(i)).cast("string") for i in range(4)])
    return load(spark, folder, "customer").select(
        "c_custkey",
        name.alias("kunde"),
        synth.synthetic("email", d).alias("contact"),
        synth.synthetic("iban", d).alias("account"),
        synth.synthetic("bic", d).alias("bank"),
        synth.synthetic("phone", d).alias("reach"),
        uuid.alias("ref"),
        ip.alias("host"),
        F.concat(F.lit("4"), F.lpad(F.col("c_custkey").cast("string"), 15, "0")).alias("card"),
        synth.synthetic("zip", d).alias("plz"),
        F.date_add(F.lit("1960-01-01").cast("date"), F.col("c_custkey").cast("int") % 9000).cast("string").alias("born"),
        F.col("c_acctbal").alias("betrag"),
        F.col("c_mktsegment").alias("kategorie"),
    )


def _card_sql() -> str:
    digits = "('4' || lpad(CAST(c_custkey AS VARCHAR), 15, '0'))"
    doubled = (
        f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CAST({digits}[i::INT] AS INT) * 2 "
        f"- CASE WHEN CAST({digits}[i::INT] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST({digits}[i::INT] AS INT) END))"
    )
    return f"{doubled} % 10 = 0"


_OCTETS = [f"(('0x' || substr(md5(c_name || '{i}'), 1, 15))::BIGINT % 300)" for i in range(4)]


def _ip_sql() -> str:
    return " AND ".join(f"{o} <= 255" for o in _OCTETS)


def _ip_like_phone_sql() -> str:
    """A leading 0 and at least seven digits also look like a phone number."""
    return f"{_OCTETS[0]} = 0 AND length(" + " || ".join(f"CAST({o} AS VARCHAR)" for o in _OCTETS) + ") >= 7"


_N = "count(*)"
_IBAN_OK = "regexp_matches(" + SYNTH_SQL["iban"] + ", '^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$')"
_VOTES = {
    "c_custkey": {}, "kunde": {}, "contact": {"email": _N},
    "account": {"iban": f"count(*) FILTER (WHERE {_IBAN_OK})"},
    "bank": {"bic": _N}, "reach": {"phone": _N}, "ref": {"uuid": _N},
    "host": {
        "ip": f"count(*) FILTER (WHERE {_ip_sql()})",
        "phone": f"count(*) FILTER (WHERE {_ip_like_phone_sql()})",
    },
    "card": {"creditcard": f"count(*) FILTER (WHERE {_card_sql()})"},
    "plz": {}, "born": {}, "betrag": {},
    "kategorie": {"bic": "count(*) FILTER (WHERE length(c_mktsegment) = 8)"},
}
_KEYS = ("email", "bic", "iban", "phone", "creditcard", "uuid", "ip")


@query(
    "i03_pii_votes",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"values\", "
        + ", ".join(f"{v.get(k, '0::BIGINT')} AS {k}" for k in _KEYS)
        + " FROM customer"
        for c, v in _VOTES.items()
    ),
)
def pii_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Matches per type of personal data in every column."""
    return scan.pii_votes(personal(spark, folder))


_FOUND = (
    ("kunde", "personname", "direct", "name"), ("contact", "email", "direct", "content"),
    ("account", "iban", "direct", "content"), ("bank", "bic", "direct", "content"),
    ("reach", "phone", "direct", "content"), ("ref", "uuid", "direct", "content"),
    ("plz", "zip", "quasi", "name"),
)


@query(
    "i03_scan_pii",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, '{lv}' AS level, '{via}' AS via, "
        f"1.0::DOUBLE AS confidence FROM (SELECT 1 FROM customer LIMIT 1)"
        for c, t, lv, via in _FOUND
    ),
)
def scan_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Content first, then column names."""
    return scan.scan_pii(personal(spark, folder))


@query(
    "i04_anon_meta",
    "SELECT 'betrag' AS \"column\", 'measure' AS role, min(c_acctbal) AS min, max(c_acctbal) AS max, "
    "greatest(1, floor(median(abs(c_acctbal)) * 0.15 + 0.5))::BIGINT AS noise, "
    "pow(10, greatest(0, floor(log10(greatest(1, median(abs(c_acctbal))))) - 1))::DOUBLE AS step FROM customer "
    "UNION ALL SELECT 'kategorie', 'category', NULL, NULL, NULL, NULL FROM (SELECT 1 FROM customer LIMIT 1) "
    "UNION ALL SELECT 'note', 'free text', NULL, NULL, NULL, NULL FROM (SELECT 1 FROM customer LIMIT 1)",
)
def anon_meta(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "customer").select(
        F.col("c_acctbal").alias("betrag"),
        F.col("c_mktsegment").alias("kategorie"),
        F.concat(F.lit("a note about "), "c_name").alias("note"),
    )
    return scan.meta_frame(df, scan.anon_meta(df, set()))


def _small(spark: SparkSession, folder: str) -> DataFrame:
    return personal(spark, folder).select("c_custkey", "kunde", "contact", "plz", "betrag", "kategorie")


_UNIT = "(('0x' || substr(md5(CAST(c_acctbal AS VARCHAR) || 'pepper'), 1, 15))::BIGINT % 2001) / 1000.0 - 1.0"
_KEY_UNIT = _UNIT.replace("c_acctbal", "c_custkey")


def _level_sql(level: int) -> str:
    """Names and contacts are replaced at level 1, codes and amounts too at level 2."""
    contact = SYNTH_SQL["email"]
    again = contact.replace("c_name", f"({contact})")
    zip_code = SYNTH_SQL["zip"]
    plz = zip_code.replace("c_name", f"({zip_code})") if level > 1 else zip_code
    amount = f"round(round(c_acctbal * (1 + ({_UNIT})::DOUBLE * 0.1), 2), 1)" if level > 1 else "round(c_acctbal, 1)"
    key = (
        f"CAST(round(c_custkey * (1 + ({_KEY_UNIT})::DOUBLE * 0.1)) AS BIGINT)" if level > 1 else "c_custkey"
    )
    return (
        f"SELECT {key} AS c_custkey, {SYNTH_SQL['fullName']} AS kunde, {again} AS contact, {plz} AS plz, "
        f"{amount} AS betrag, c_mktsegment AS kategorie FROM customer"
    )


def _protected(spark: SparkSession, folder: str, level: int) -> DataFrame:
    out = protection.anonymise(_small(spark, folder), level, salt="pepper")
    return out.withColumn("betrag", F.round("betrag", 1))


@query("i05_anonymise_1", _level_sql(1))
def anonymise_1(spark: SparkSession, folder: str) -> DataFrame:
    return _protected(spark, folder, 1)


@query("i05_anonymise_2", _level_sql(2))
def anonymise_2(spark: SparkSession, folder: str) -> DataFrame:
    return _protected(spark, folder, 2)


def _pick(words: list[str], column: str, number: int) -> str:
    unit = sql_unit("c_custkey", Context(seed=3).seed_for(column) + number)
    return f"{sql_list(words)}[CAST(floor({unit} * {len(words)}) AS BIGINT) + 1]"


def _between(column: str, source: str) -> str:
    unit = sql_unit("c_custkey", Context(seed=3).seed_for(column))
    low, high = (f"(SELECT {f}({source}) FROM customer)" for f in ("min", "max"))
    return f"{low} + {unit} * ({high} - {low})"


@query(
    "i05_anonymise_3",
    f"SELECT CAST(round({_between('c_custkey', 'c_custkey')}) AS BIGINT) AS c_custkey, "
    f"{_pick(fixed.FIRST_NAMES, 'kunde', 1)} || ' ' || {_pick(fixed.LAST_NAMES, 'kunde', 2)} AS kunde, "
    f"lower({_pick(fixed.FIRST_NAMES, 'contact', 1)}) || '.' || lower({_pick(fixed.LAST_NAMES, 'contact', 2)}) "
    f"|| '@' || {_pick(fixed.DOMAINS, 'contact', 3)} AS contact, "
    f"lpad(CAST(CAST(floor({sql_unit('c_custkey', Context(seed=3).seed_for('plz') + 1)} * 100000) AS BIGINT) "
    "AS VARCHAR), 5, '0') AS plz, "
    f"round(round({_between('betrag', 'c_acctbal')}, 2), 1) AS betrag, c_mktsegment AS kategorie FROM customer",
)
def anonymise_3(spark: SparkSession, folder: str) -> DataFrame:
    """Everything drawn at random, by the key of the row before it was replaced."""
    out = protection.anonymise(_small(spark, folder), 3, salt="pepper", seed=3, key=("c_custkey",))
    return out.withColumn("betrag", F.round("betrag", 1))


@query(
    "i06_review",
    "SELECT 1::BIGINT AS position, 'c_custkey' AS \"column\", '' AS cleaning, NULL AS pii_type, 'numNoise' AS action, "
    "false AS handled FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 2, 'kunde', '', 'personname', 'synth', false FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 3, 'contact', '', 'email', 'synth', false FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 4, 'plz', '', 'zip', 'synth', false FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL "
    "SELECT 5, 'betrag', '', NULL, 'numNoise', false FROM (SELECT 1 FROM customer LIMIT 1)",
)
def review(spark: SparkSession, folder: str) -> DataFrame:
    table = protection.review(_small(spark, folder), 2)
    return table.select(
        "position", "column", F.array_join("cleaning", ",").alias("cleaning"), "pii_type", "action", "handled"
    )
