"""Column profiles: counts, distinct values, quantiles, histograms, frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import categories, col, text_of
from tablewright.operators.distributed import exact_quantiles
from tablewright.operators.patterns import top_per_group
from tablewright.operators.sketches import profile_state, state_summary

HISTOGRAM_BINS = 30
TOP_VALUES = 20
SHORT_TEXT = 64

# Span in days up to which a bucket is used, and the label of a bucket.
BUCKET_SPANS = (("hour", 2), ("day", 60), ("month", 365 * 3))
BUCKET_LABELS = {
    "hour": "yyyy-MM-dd HH:00",
    "day": "yyyy-MM-dd",
    "month": "yyyy-MM",
    "year": "yyyy",
}


def describe(df: DataFrame) -> DataFrame:
    """(position, column, type, category, nullable) of the schema."""
    kinds = categories(df)
    rows = [
        (i, f.name, f.dataType.simpleString(), kinds[f.name], f.nullable)
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "position bigint, column string, type string, category string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    rows = [(i, n) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "position bigint, column string")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, total, non_null, nulls), one aggregate for all columns."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("total"),
                F.col(f"n{i}").alias("non_null"),
                (F.col("total") - F.col(f"n{i}")).alias("nulls"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.inline(rows))


def _key_text(df: DataFrame, name: str) -> Column:
    """A short text that differs exactly when values differ; long text by its SHA-256."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BinaryType):
        text = F.hex(col(name))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = (col(name) + F.lit(0.0).cast(dtype)).cast("string")  # -0.0 counts as 0.0
    else:
        text = col(name).cast("string")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        long = F.char_length(text) > SHORT_TEXT
        text = F.when(long, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)
    return text


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, distinct) of all columns that are not nested.

    Exact: the cells of all columns are laid out as (column, value) and grouped
    twice, so one hot value or one wide column stays a map-side sum.
    """
    names = [n for n, k in categories(df).items() if k != "complex"]
    if approx:
        row = df.agg(
            *[F.approx_count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(names)]
        )
        pairs = F.array(
            *[F.struct(F.lit(n).alias("column"), F.col(f"d{i}").alias("distinct")) for i, n in enumerate(names)]
        )
        return row.select(F.inline(pairs))
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), _key_text(df, n).alias("v")) for i, n in enumerate(names)]
    )
    counted = (
        df.select(F.inline(cells))
        .groupBy("i", "v")
        .agg(F.lit(1))
        .groupBy("i")
        .agg(F.count("v").alias("distinct"))
    )
    named = _named(df, names)
    return named.join(counted, named["position"] == counted["i"], "left").select(
        "column", F.coalesce("distinct", F.lit(0)).alias("distinct")
    )


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max, avg, std, median, q1, q3) of numeric columns.

    Eager: basic figures in one pass, then exact quantiles.
    """
    kinds = categories(df)
    names = columns or [n for n, k in kinds.items() if k in ("integer", "numeric")]
    rows = [(n, *v[1:]) for n, v in _numeric_rows(df, names).items()]
    schema = (
        "column string, min double, max double, avg double, std double, "
        "median double, q1 double, q3 double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def _numeric_rows(df: DataFrame, names: list[str]) -> dict[str, tuple]:
    """name -> (count, min, max, avg, std, median, q1, q3)."""
    if not names:
        return {}
    x = {n: col(n).cast("double") for n in names}
    basics = df.agg(
        *[f(x[n]) for n in names for f in (F.count, F.min, F.max, F.avg, F.stddev_pop)]
    ).first()
    base = {n: tuple(basics[i * 5 : i * 5 + 5]) for i, n in enumerate(names)}
    quantiles = exact_quantiles(df, x, [0.5, 0.25, 0.75], {n: base[n][0] for n in names})
    return {n: base[n] + tuple(quantiles[n]) for n in names}


def _bin(c: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value, from 1; NULL has none."""
    place = F.floor((c.cast("double") - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins) + 1
    inside = F.least(F.lit(bins), F.greatest(F.lit(1), place)).cast("int")
    return F.when(c.isNotNull(), inside)


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, lower, upper, count): equal widths, empty bins present, the last bin closed.

    A column with one value gives one bin with count 0.
    """
    x = col(column).cast("double")
    lo, hi = df.agg(F.min(x)).scalar(), df.agg(F.max(x)).scalar()
    counts = (
        df.where(col(column).isNotNull())
        .groupBy(_bin(col(column), lo, hi, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("b"))
    width = (hi - lo) / bins
    flat = lo == hi
    return (
        frame.where(lo.isNotNull() & (~flat | (F.col("b") == 1)))
        .join(counts, frame["b"] == counts["bin"], "left")
        .select(
            F.col("b").cast("bigint").alias("bin"),
            (lo + (F.col("b") - 1) * width).alias("lower"),
            F.when(flat, hi).otherwise(lo + F.col("b") * width).alias("upper"),
            F.when(flat, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("count"),
        )
    )


def top_values(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """(value, count): most frequent values, smaller values first among equals."""
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "value")
        .limit(n)
    )


def length_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min_len, max_len, avg_len) of text columns in one aggregate."""
    names = columns or [n for n, k in categories(df).items() if k == "string"]
    sizes = {n: F.char_length(text_of(df, n)) for n in names}
    row = df.agg(
        *[
            f(sizes[n]).cast(t).alias(f"{tag}{i}")
            for i, n in enumerate(names)
            for f, t, tag in ((F.min, "bigint", "a"), (F.max, "bigint", "b"), (F.avg, "double", "c"))
        ]
    )
    entries = [
        F.struct(
            F.lit(n).alias("column"),
            F.col(f"a{i}").alias("min_len"),
            F.col(f"b{i}").alias("max_len"),
            F.col(f"c{i}").alias("avg_len"),
        )
        for i, n in enumerate(names)
    ]
    return row.select(F.inline(F.array(*entries)))


def bucket_for(lo: Column, hi: Column) -> Column:
    """hour, day, month or year, by the span between two times."""
    days = (_seconds(hi) - _seconds(lo)) / F.lit(86400.0)
    out = F.when(days <= BUCKET_SPANS[0][1], BUCKET_SPANS[0][0])
    for name, span in BUCKET_SPANS[1:]:
        out = out.when(days <= span, name)
    return out.otherwise("year")


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def _bucket_label(c: Column, bucket: Column) -> Column:
    time = c.cast("timestamp_ntz")
    out = F.lit(None).cast("string")
    for name, label in BUCKET_LABELS.items():
        text = F.date_format(F.date_trunc(name, time), label)
        out = F.when(bucket == name, text).otherwise(out)
    return out


def time_buckets(df: DataFrame, column: str, cap: int | None = None) -> DataFrame:
    """(bucket, label, count): rows per hour, day, month or year, in order; `cap` asks for the first labels."""
    c = col(column)
    unit = df.agg(bucket_for(F.min(c), F.max(c))).scalar()
    counted = (
        df.where(c.isNotNull())
        .select(unit.alias("bucket"), _bucket_label(c, unit).alias("label"))
        .groupBy("bucket", "label")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("label")
    )
    return counted if cap is None else counted.limit(cap)


def bool_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), NULL among the values."""
    return df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def quality_kpis(df: DataFrame) -> DataFrame:
    """One row: fill rate, full and empty columns, mean uniqueness, key candidates, constants."""
    nulls, distinct = null_counts(df), distinct_counts(df)
    both = nulls.join(distinct, "column", "left")
    d, filled, total = F.col("distinct"), F.col("non_null"), F.col("total")
    share = F.when(filled > 0, F.least(F.lit(1.0), d / filled))
    return both.agg(
        F.count(F.lit(1)).alias("columns"),
        F.max("total").alias("rows"),
        (F.sum("non_null") / F.nullif(F.sum("total"), F.lit(0))).alias("fill_rate"),
        F.count_if((F.col("nulls") == 0) & (total > 0)).alias("full_columns"),
        F.count_if((filled == 0) & (total > 0)).alias("empty_columns"),
        F.avg(F.when(d.isNotNull(), share)).alias("uniqueness"),
        F.count_if((total > 0) & (d == total) & (F.col("nulls") == 0)).alias("key_candidates"),
        F.count_if(d == 1).alias("constant_columns"),
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column with the figures of its category.

    Eager, in shared passes: counts, ranges and lengths; distinct counts;
    quantiles; then histograms, time buckets, frequent values and truth
    counts, which are bounded per column.
    """
    spark, kinds, names = df.sparkSession, categories(df), df.columns
    numeric = [n for n in names if kinds[n] in ("integer", "numeric")]
    textual = [n for n in names if kinds[n] in ("string", "binary", "other")]
    temporal = [n for n in names if kinds[n] == "temporal"]
    boolean = [n for n in names if kinds[n] == "boolean"]

    aggs = [F.count(F.lit(1)).alias("total")]
    for i, n in enumerate(names):
        aggs.append(F.count(col(n)).alias(f"n{i}"))
        if n in numeric:
            x = col(n).cast("double")
            aggs += [f(x).alias(f"{t}{i}") for f, t in ((F.min, "lo"), (F.max, "hi"), (F.avg, "av"), (F.stddev_pop, "sd"))]
        elif n in textual:
            size = F.octet_length(col(n)) if kinds[n] == "binary" else F.char_length(text_of(df, n))
            aggs += [f(size).alias(f"{t}{i}") for f, t in ((F.min, "lo"), (F.max, "hi"), (F.avg, "av"))]
        elif n in temporal:
            aggs += [
                F.min(col(n)).cast("string").alias(f"lo{i}"),
                F.max(col(n)).cast("string").alias(f"hi{i}"),
                bucket_for(F.min(col(n)), F.max(col(n))).alias(f"bk{i}"),
            ]
    s = df.agg(*aggs).first()
    at = {n: i for i, n in enumerate(names)}
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(df).collect()}
    quantiles = exact_quantiles(
        df,
        {n: col(n).cast("double") for n in numeric},
        [0.5, 0.25, 0.75],
        {n: s[f"n{at[n]}"] for n in numeric},
    )

    # everything that is a short list per column: (column, kind, label, count)
    cells = []
    for n in numeric:
        lo, hi = s[f"lo{at[n]}"], s[f"hi{at[n]}"]
        if lo is not None and lo != hi:
            b = _bin(col(n), F.lit(lo), F.lit(hi), HISTOGRAM_BINS).cast("string")
            cells.append((n, "bin", b))
    for n in temporal:
        if s[f"n{at[n]}"]:
            cells.append((n, "time", _bucket_label(col(n), F.lit(s[f"bk{at[n]}"]))))
    cells += [(n, "bool", col(n).cast("string")) for n in boolean]
    lists: dict[str, list] = {n: [] for n in names}
    if cells:
        laid = F.array(*[F.struct(F.lit(at[n]).alias("i"), v.alias("label")) for n, _, v in cells])
        counted = df.select(F.inline(laid)).groupBy("i", "label").agg(F.count(F.lit(1)).alias("n"))
        keep = counted.where(F.col("label").isNotNull() | F.col("i").isin([at[n] for n in boolean] or [-1]))
        for r in keep.collect():  # bins, truth values, and time labels: hours up to days, or years
            lists[names[r["i"]]].append((r["label"], r["n"]))
    if textual:
        laid = F.array(*[F.struct(F.lit(at[n]).alias("i"), text_of(df, n).alias("v")) for n in textual])
        counted = df.select(F.inline(laid)).where("v IS NOT NULL").groupBy("i", "v")
        counted = counted.agg(F.count(F.lit(1)).alias("n"))
        top = top_per_group(counted, "i", [F.col("n").desc(), F.col("v")], TOP_VALUES, "r")
        for r in top.orderBy("i", "r").collect():
            lists[names[r["i"]]].append((r["v"], r["n"]))

    rows = []
    for i, n in enumerate(names):
        total, filled, kind = s["total"], s[f"n{i}"], kinds[n]
        row: dict = {}
        row.update(
            position=i, column=n, type=df.schema[n].dataType.simpleString(), category=kind,
            nullable=df.schema[n].nullable, total=total, non_null=filled, nulls=total - filled,
            distinct=distinct.get(n),
        )
        if n in numeric:
            med, q1, q3 = quantiles[n]
            lo, hi = s[f"lo{i}"], s[f"hi{i}"]
            row.update(min=lo, max=hi, avg=s[f"av{i}"], std=s[f"sd{i}"], median=med, q1=q1, q3=q3)
            if lo is not None:
                counts = {int(k): v for k, v in lists[n]}
                width = (hi - lo) / HISTOGRAM_BINS
                row["histogram"] = (
                    [(lo, hi, 0)]
                    if lo == hi
                    else [
                        (lo + b * width, lo + (b + 1) * width, counts.get(b + 1, 0))
                        for b in range(HISTOGRAM_BINS)
                    ]
                )
        elif n in textual:
            row.update(min_len=s[f"lo{i}"], max_len=s[f"hi{i}"], avg_len=s[f"av{i}"], top_values=lists[n])
        elif n in temporal:
            row.update(min_text=s[f"lo{i}"], max_text=s[f"hi{i}"])
            row.update(bucket=s[f"bk{i}"] if filled else None, time_buckets=sorted(lists[n]))
        elif n in boolean:
            row["bool_counts"] = lists[n]
        rows.append(row)
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


_PAIRS = "array<struct<label:string,count:bigint>>"
PROFILE_SCHEMA = (
    "position bigint, column string, type string, category string, nullable boolean, "
    "total bigint, non_null bigint, nulls bigint, distinct bigint, "
    "min double, max double, avg double, std double, median double, q1 double, q3 double, "
    "histogram array<struct<lower:double,upper:double,count:bigint>>, "
    "min_len bigint, max_len bigint, avg_len double, "
    f"top_values {_PAIRS}, min_text string, max_text string, bucket string, "
    f"time_buckets {_PAIRS}, bool_counts {_PAIRS}"
)


def summarize(df: DataFrame, approx: bool = True) -> DataFrame:
    """(column, type, min, max, distinct, avg, std, q25, q50, q75, count, null_percentage).

    By default distinct counts and quartiles come from the sketches of `sketches.profile_state`, with the
    errors stated there, in one pass; otherwise all figures are exact.
    """
    if approx:
        return state_summary(profile_state(df)).drop("top_values")
    kinds = categories(df)
    names = [n for n in df.columns if kinds[n] != "complex"]
    ranges = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.min(col(n)).cast("string").alias(f"lo{i}") for i, n in enumerate(names)],
        *[F.max(col(n)).cast("string").alias(f"hi{i}") for i, n in enumerate(names)],
    ).first()
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(df).collect()}
    numbers = _numeric_rows(df, [n for n in names if kinds[n] in ("integer", "numeric")])
    rows = []
    for i, n in enumerate(names):
        _, _, _, avg, std, q50, q25, q75 = numbers.get(n, (None,) * 8)
        total = ranges["total"]
        share = 100.0 * (total - ranges[f"n{i}"]) / total if total else None
        rows.append(
            (n, df.schema[n].dataType.simpleString(), ranges[f"lo{i}"], ranges[f"hi{i}"],
             distinct.get(n), avg, std, q25, q50, q75, total, share)
        )
    schema = (
        "column string, type string, min string, max string, distinct bigint, avg double, "
        "std double, q25 double, q50 double, q75 double, count bigint, null_percentage double"
    )
    return df.sparkSession.createDataFrame(rows, schema)
