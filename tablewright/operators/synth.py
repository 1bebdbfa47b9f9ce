"""Synthetic values: per value or per row, and collision-free pseudonyms per entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import fixed
from tablewright.functions.columns import col, text_of
from tablewright.functions.hashing import draw, random_draw
from tablewright.operators.distributed import hash_order, lookup_join

STRUCTURED = ("email", "phone", "zip", "street", "iban")
CONSISTENT = ("fullName", "company", "autoEntity") + STRUCTURED

Draw = Callable[[str, int], Column]  # (suffix, modulus) -> number in 0 .. modulus-1


def pick(words: list[str], index: Column) -> Column:
    listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return F.element_at(F.expr(f"array({listed})"), (index + 1).cast("int"))


def iban(account: Column) -> Column:
    """German IBAN with its check digits from 18 account digits."""
    number = F.concat(account, F.lit("131400")).cast("decimal(38,0)")
    check = (F.lit(98) - number % 97).cast("int").cast("string")
    return F.concat(F.lit("DE"), F.lpad(check, 2, "0"), account)


def deterministic(text: Column, salt: str) -> Draw:
    return lambda suffix, modulus: draw(text, modulus, salt, suffix)


def randomly(key: Column, seed: int) -> Draw:
    """Draws per row key; the seed moves on with every draw."""
    state = [seed]

    def one(_suffix: str, modulus: int) -> Column:
        state[0] += 1
        return random_draw(key, modulus, state[0])

    return one


def synthetic(category: str, d: Draw) -> Column:
    """A made-up value of a category; unknown categories give a full name."""

    def one(words: list[str], suffix: str) -> Column:
        return pick(words, d(suffix, len(words)))

    def digits(suffix: str, modulus: int, width: int, start: int = 0) -> Column:
        return F.lpad((d(suffix, modulus) + start).cast("string"), width, "0")

    simple = {
        "firstName": (fixed.FIRST_NAMES, ""),
        "lastName": (fixed.LAST_NAMES, ""),
        "city": (fixed.CITIES, ""),
        "country": (fixed.COUNTRIES, ""),
        "company": (fixed.COMPANIES, ""),
        "bic": (fixed.BICS, "B"),
    }
    if category in simple:
        return one(*simple[category])
    if category == "street":
        number = (d("N", 150) + 1).cast("string")
        return F.concat(one(fixed.STREETS, "S"), F.lit(" "), number)
    if category == "phone":
        return F.concat(F.lit("+49 "), digits("P1", 900, 3, 100), F.lit(" "), digits("P2", 10**7, 7))
    if category == "zip":
        return digits("Z", 100_000, 5)
    if category == "iban":
        return iban(digits("IB", 10**18, 18))
    if category == "text":
        words = [one(fixed.LOREM, f"L{i}") for i in range(1, 7)]
        return F.concat(F.concat_ws(" ", F.initcap(words[0]), *words[1:]), F.lit("."))
    first, last = one(fixed.FIRST_NAMES, "F"), one(fixed.LAST_NAMES, "L")
    if category == "email":
        at = F.concat(F.lit("@"), one(fixed.DOMAINS, "D"))
        return F.concat(F.lower(first), F.lit("."), F.lower(last), at)
    return F.concat(first, F.lit(" "), last)


# ---------------------------------------------------------------- one label per entity


def _pair(rank: Column, heads: list[str], tails: list[str]) -> tuple[Column, Column, Column]:
    """Two words that walk through all pairs, and the number beyond them."""
    at = rank - 1
    n = len(heads)
    head = pick(heads, F.pmod(at, F.lit(n)))
    tail = pick(tails, F.pmod(F.floor(at / n), F.lit(len(tails))))
    more = F.when(rank > n * len(tails), rank.cast("string")).otherwise("")
    return head, tail, more


def _spaced(head: Column, tail: Column, more: Column) -> Column:
    return F.concat(head, F.lit(" "), tail, F.when(more != "", F.concat(F.lit(" "), more)).otherwise(""))


def person_label(rank: Column) -> Column:
    return _spaced(*_pair(rank, fixed.FIRST_NAMES, fixed.LAST_NAMES))


def org_label(rank: Column) -> Column:
    return _spaced(*_pair(rank, fixed.ORG_NAMES, fixed.LEGAL_FORMS))


def structured_label(category: str, rank: Column) -> Column:
    """A label per rank that no other rank shares."""
    text = rank.cast("string")
    if category == "iban":
        return iban(F.lpad(text, 18, "0"))
    if category == "email":
        first, last, more = _pair(rank, fixed.FIRST_NAMES, fixed.LAST_NAMES)
        domain = pick(fixed.DOMAINS, F.pmod(rank - 1, F.lit(len(fixed.DOMAINS))))
        return F.concat(F.lower(first), F.lit("."), F.lower(last), more, F.lit("@"), domain)
    if category == "phone":
        area = F.lpad((F.pmod(rank - 1, F.lit(900)) + 100).cast("string"), 3, "0")
        return F.concat(F.lit("+49 "), area, F.lit(" "), _padded(text, 7))
    if category == "zip":
        return _padded(text, 5)
    streets = len(fixed.STREETS)
    number = (F.floor((rank - 1) / streets) + 1).cast("string")
    return F.concat(pick(fixed.STREETS, F.pmod(rank - 1, F.lit(streets))), F.lit(" "), number)


def _padded(text: Column, width: int) -> Column:
    """Left zeros; longer numbers stay whole, so labels stay distinct."""
    return F.when(F.char_length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def is_org(text: Column) -> Column:
    return text.rlike(fixed.ORG_PATTERN)


def is_authority(text: Column) -> Column:
    return text.rlike(fixed.AUTHORITY_PATTERN)


def entity_map(
    df: DataFrame,
    column: str,
    category: str = "autoEntity",
    k: int = 5,
    salt: str = "",
    keep_authorities: bool = False,
) -> DataFrame:
    """(v, cnt, rk, pseud): one pseudonym per distinct value, ranked by salted hash.

    Entities with fewer than `k` rows share one label.
    """
    counted = df.where(col(column).isNotNull()).groupBy(col(column).alias("v"))
    counted = counted.agg(F.count(F.lit(1)).alias("cnt"))
    text = text_of(counted, "v")
    hashed = F.md5(F.concat(text, F.lit(salt)) if salt else text)
    ranked = hash_order(counted.withColumn("_hash", hashed), "_hash", "v")
    ranked = ranked.withColumnRenamed("_rank", "rk")
    rk, rare = F.col("rk"), (F.col("cnt") < k) if k > 0 else F.lit(False)
    if category in STRUCTURED:
        label = F.when(rare, fixed.RARE_LABELS[category]).otherwise(structured_label(category, rk))
    elif category == "company":
        label = F.when(rare, fixed.RARE_ORG).otherwise(org_label(rk))
    elif category == "autoEntity":
        authority = is_authority(text)
        org = is_org(text) if keep_authorities else is_org(text) | authority
        shared = F.when(org, fixed.RARE_ORG).otherwise(fixed.RARE_PERSON)
        label = F.when(rare, shared).otherwise(F.when(org, org_label(rk)).otherwise(person_label(rk)))
        if keep_authorities:
            label = F.when(authority, text).otherwise(label)
    else:
        label = F.when(rare, fixed.RARE_PERSON).otherwise(person_label(rk))
    return ranked.select("v", "cnt", "rk", label.alias("pseud"))


def is_collapsed(category: str) -> Column:
    """True for map entries that share the label of the rare entities."""
    if category in STRUCTURED:
        return F.col("pseud") == fixed.RARE_LABELS[category]
    return F.col("pseud").isin(fixed.RARE_PERSON, fixed.RARE_ORG)


def apply_map(df: DataFrame, column: str, mapping: DataFrame, value: str, weight: str) -> DataFrame:
    """Replace a column through a (v, value, weight) map, NULL stays NULL.

    `mapping` has one row per value with its number of rows, which keeps hot
    values out of the shuffle.
    """
    named = mapping.select(
        F.col("v").alias(column), col(value).alias("_new"), col(weight).alias("_weight")
    )
    joined = lookup_join(df, [column], named, "_weight")
    return joined.select(
        *[(F.col("_new").alias(c) if c == column else col(c)) for c in df.columns]
    )
