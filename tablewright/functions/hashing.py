"""Numbers drawn from a value: the same value and salt give the same draw."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash60(text: Column, salt: str = "", suffix: str = "") -> Column:
    """A 60-bit number from the md5 of text, salt and suffix."""
    salted = F.concat(text, F.lit(salt + suffix)) if salt + suffix else text
    return F.conv(F.substring(F.md5(salted), 1, 15), 16, 10).cast("bigint")


def draw(text: Column, modulus: int | Column, salt: str = "", suffix: str = "") -> Column:
    """A whole number in 0 .. modulus-1 that depends on the value only."""
    size = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.pmod(hash60(text, salt, suffix), size.cast("bigint"))


def random_unit(key: Column, seed: int) -> Column:
    """A double in 0 .. 1 (open) with 52 random bits, drawn per row key: no state, so any task draws alike."""
    bits = F.substring(F.md5(F.concat(key, F.lit(f"|{seed}"))), 1, 13)
    return F.conv(bits, 16, 10).cast("bigint") / F.lit(2.0**52)


def random_draw(key: Column, modulus: int | Column, seed: int) -> Column:
    """A whole number in 0 .. modulus-1 drawn per row key."""
    size = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.least(F.floor(random_unit(key, seed) * size), size - 1).cast("bigint")


def unit(text: Column, salt: str = "") -> Column:
    """A step of 0.001 in -1 .. 1 that depends on the value only."""
    return draw(text, 2001, salt) / F.lit(1000.0) - F.lit(1.0)


def row_hash(columns: list[Column]) -> Column:
    """md5 over a row; NULL and empty text differ."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
