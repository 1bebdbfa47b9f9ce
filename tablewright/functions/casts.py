"""Conversions that give NULL instead of an error."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# Cast targets and the Spark types behind them.
TARGET_TYPES = {
    "BOOLEAN": "boolean",
    "TINYINT": "tinyint",
    "SMALLINT": "smallint",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "HUGEINT": "decimal(38,0)",
    "FLOAT": "float",
    "DOUBLE": "double",
    "DECIMAL": "decimal(18,3)",
    "DECIMAL(18,2)": "decimal(18,2)",
    "VARCHAR": "string",
    "DATE": "date",
    "TIME": "time",
    "TIMESTAMP": "timestamp_ntz",
    "UUID": "string",
}
WHOLE_TARGETS = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT")
TEMPORAL_TARGETS = ("DATE", "TIMESTAMP", "TIME")

# Human and percent date codes with their Java pattern letters.
# Single letters, so that one- and two-digit days and months both parse.
HUMAN_CODES = {
    "YYYY": "yyyy",
    "YY": "yy",
    "MM": "M",
    "DD": "d",
    "HH": "H",
    "hh": "h",
    "mm": "m",
    "MI": "m",
    "SS": "s",
    "ss": "s",
}
PERCENT_CODES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "M",
    "%d": "d",
    "%H": "H",
    "%I": "h",
    "%M": "m",
    "%S": "s",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "D",
}

UUID_PATTERN = r"(?i)\A[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\z"
_FULL_DATE = r"\A\s*[+-]?\d+-\d{1,2}-\d{1,2}(\s*\z|[T ])"


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def to_time(c: Column) -> Column:
    """HH:mm:ss text of a time of day; Spark's TIME type is off by default."""
    return F.date_format(c, "HH:mm:ss")


def convert(c: Column, source: T.DataType, target: str) -> Column:
    """Cast `c` of type `source`; what does not fit becomes NULL.

    Text with a fraction is rounded half away from zero when it becomes a
    whole number, doubles are rounded half to even.
    """
    target = target.upper()
    spark_type = TARGET_TYPES.get(target, target.lower())
    text = _is_text(source)
    if target in WHOLE_TARGETS:
        if text:
            c = F.round(c.try_cast("decimal(38,10)"), 0)
        elif isinstance(source, T.DecimalType):
            c = F.round(c, 0)
        elif isinstance(source, (T.FloatType, T.DoubleType)):
            c = F.bround(c, 0)
        return c.try_cast(spark_type)
    if target in ("DOUBLE", "FLOAT") and text:
        # the JVM reads a trailing d or f as a type suffix
        return F.when(~c.rlike(r"[0-9.][dDfF]\s*\z"), c.try_cast(spark_type))
    if target == "UUID":
        return F.when(c.cast("string").rlike(UUID_PATTERN), F.lower(c.cast("string")))
    if target in TEMPORAL_TARGETS:
        if target == "TIME":
            if text:
                clock = F.concat(F.lit("1970-01-01 "), F.trim(c))
                ok = c.rlike(r"\A\s*\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*\z")
                return F.when(ok, to_time(clock.try_cast("timestamp_ntz")))
            return to_time(c.try_cast("timestamp_ntz"))
        if text:
            c = F.when(c.rlike(_FULL_DATE), c).try_cast("timestamp_ntz")
        return c.try_cast(spark_type)
    return c.try_cast(spark_type)


def java_pattern(pattern: str) -> str:
    """DD.MM.YYYY or %d.%m.%Y as a Spark date pattern."""
    pattern = pattern.strip()
    codes = PERCENT_CODES if "%" in pattern else HUMAN_CODES
    finder = re.compile("|".join(sorted(codes, key=len, reverse=True)))
    out, at = [], 0
    for hit in finder.finditer(pattern):
        out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", pattern[at : hit.start()]))
        out.append(codes[hit[0]])
        at = hit.end()
    out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", pattern[at:]))
    return "".join(out)


def pattern_list(formats: str | list[str] | None) -> list[str]:
    """Patterns from a list, or from text split at line ends, commas and semicolons."""
    parts = re.split(r"[\n,;]+", formats) if isinstance(formats, str) else (formats or [])
    return [java_pattern(p) for p in parts if p.strip()]


def pattern_shape(pattern: str) -> str:
    """Regular expression that every text of a date pattern fits.

    A text that does not fit is not parsed at all, since a failed parse costs
    an exception per row.
    """
    sizes = {"yyyy": r"\d{4}", "yy": r"\d{2}", "SSSSSS": r"\d{6}", "D": r"\d{1,3}"}
    out = []
    for piece in re.findall(r"'[^']*'|[A-Za-z]+|[^A-Za-z']+", pattern):
        if piece.startswith("'"):
            out.append(re.escape(piece.strip("'")))
        elif piece in sizes:
            out.append(sizes[piece])
        elif piece in ("d", "M", "H", "h", "m", "s"):
            out.append(r"\d{1,2}")
        else:
            out.append(".+" if piece[0].isalpha() else re.escape(piece))
    return r"\A" + "".join(out) + r"\z"


def parse_temporal(text: Column, patterns: list[str]) -> Column:
    """First pattern that fits wins; a two-digit year above 68 is in the 1900s."""

    def one(pattern: str) -> Column:
        fits = text.rlike(pattern_shape(pattern))
        parsed = F.when(fits, F.try_to_timestamp(text, F.lit(pattern))).cast("timestamp_ntz")
        if "yy" in pattern and "yyyy" not in pattern:
            century = F.expr("INTERVAL 100 YEARS")
            parsed = F.when(F.year(parsed) >= 2069, parsed - century).otherwise(parsed)
        return parsed

    return F.coalesce(*[one(p) for p in patterns])


def temporal_target(parsed: Column, target: str) -> Column:
    if target == "TIME":
        return to_time(parsed)
    return parsed.cast(TARGET_TYPES[target])


def parse_number(text: Column, decimal: str, target: str) -> Column:
    """Number out of text with currency signs and thousands marks."""
    keep = "[^0-9,-]" if decimal == "," else "[^0-9.-]"
    digits = F.regexp_replace(F.trim(text), keep, "")
    if decimal == ",":
        digits = F.replace(digits, F.lit(","), F.lit("."))
    return convert(F.nullif(digits, F.lit("")), T.StringType(), target)
