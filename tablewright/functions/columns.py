"""Column categories and the text form of a cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.DayTimeIntervalType,
    T.YearMonthIntervalType,
)
COMPLEX_TYPES = (T.StructType, T.MapType, T.ArrayType)


def category(dtype: T.DataType) -> str:
    """integer, numeric, string, temporal, boolean, binary, complex or other."""
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0 and dtype.precision > 18:
        return "integer"
    for name, kinds in (
        ("integer", INTEGER_TYPES),
        ("numeric", NUMERIC_TYPES),
        ("string", (T.StringType, T.VarcharType, T.CharType)),
        ("temporal", TEMPORAL_TYPES),
        ("boolean", (T.BooleanType,)),
        ("binary", (T.BinaryType,)),
        ("complex", COMPLEX_TYPES),
    ):
        if isinstance(dtype, kinds):
            return name
    return "temporal" if dtype.simpleString().startswith("time") else "other"


def categories(df: DataFrame) -> dict[str, str]:
    return {f.name: category(f.dataType) for f in df.schema.fields}


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def double_text(x: Column) -> Column:
    """Doubles without exponent up to 1e16, as people write them."""
    size = F.abs(x)
    plain = F.regexp_replace(
        x.cast("string").try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1"
    )
    exponent = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(exponent, plain).otherwise(x.cast("string"))


def text_of(df: DataFrame, name: str) -> Column:
    """The cell as text; NULL stays NULL, nested values become JSON."""
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, COMPLEX_TYPES):
        return F.to_json(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return double_text(c)
    return c.cast("string")


def cell_text(df: DataFrame, name: str) -> Column:
    """Display text of a cell: as text_of, with 'null' for NULL."""
    return F.coalesce(text_of(df, name), F.lit("null"))


def number_of(df: DataFrame, name: str) -> Column:
    """The cell as double, NULL where it is no number."""
    from tablewright.functions.casts import convert

    return convert(col(name), df.schema[name].dataType, "DOUBLE")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One column replaced in place."""
    return df.withColumn(name, value)


def orderable(df: DataFrame) -> list[str]:
    """Columns that can be compared and grouped (no maps inside)."""

    def has_map(t: T.DataType) -> bool:
        if isinstance(t, T.MapType):
            return True
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        if isinstance(t, T.StructType):
            return any(has_map(f.dataType) for f in t.fields)
        return False

    return [f.name for f in df.schema.fields if not has_map(f.dataType)]
