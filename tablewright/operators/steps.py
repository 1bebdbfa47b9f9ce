"""Cleaning and anonymising steps.

A step is a frozen dataclass.  `apply` turns a DataFrame into the next one;
an incomplete step is skipped by the pipeline.  Steps that only look at the
row offer `cell`, the new value of their column.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions import casts, patterns
from tablewright.functions.columns import all_of, col, number_of, replace_column, text_of
from tablewright.functions.hashing import draw, random_draw, random_unit, row_hash, unit
from tablewright.operators import synth
from tablewright.operators.distributed import (
    hash_order,
    interval_lookup,
    running_sum,
    settle,
    with_row_id,
)


ROW_BLOCKS = 65_536
ROW_KEY = "_row_key"


@dataclass(frozen=True)
class Context:
    """What all steps of a pipeline share: the salt, the seed of random draws and the key of a row.

    A draw depends on the seed, the column and the row's key alone, so equal tables draw alike however
    they are partitioned, and a task that runs again draws the same.
    """

    salt: str = ""
    seed: int = 0
    key: tuple[str, ...] = ()

    def row_key(self, df: DataFrame) -> Column:
        """The key that `with_row_key` gave; on streams, and where rows are only counted, the row itself."""
        if ROW_KEY in df.columns:
            return col(ROW_KEY)
        return self._named(df) if self.key else row_hash([col(c) for c in df.columns])

    def _named(self, df: DataFrame) -> Column:
        parts = [F.coalesce(text_of(df, k), F.lit("")) for k in self.key]
        return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)

    def with_row_key(self, df: DataFrame) -> DataFrame:
        """Adds the key of each row for random draws: the key columns, else the row and the number of its copy."""
        if self.key:
            return df.withColumn(ROW_KEY, self._named(df))
        return df if df.isStreaming else with_row_id(df, ROW_KEY)

    def seed_for(self, name: str) -> int:
        """A seed of its own per column."""
        return int(hashlib.sha256(f"{self.seed}:{name}".encode()).hexdigest()[:12], 16)


class Step:
    """Base of all steps.

    impact: how the effect is measured (cast, extract, cell, rows, shuffle,
    pseudo, coarsen, struct).  wide: the step shuffles or reads its input more
    than once.  anonymises / random: what kind of replacement it does.
    """

    impact: ClassVar[str] = "struct"
    kind: ClassVar[str] = ""

    @property
    def complete(self) -> bool:
        return bool(getattr(self, "column", ""))

    @property
    def wide(self) -> bool:
        return False

    @property
    def random(self) -> bool:
        return False

    @property
    def anonymises(self) -> bool:
        return False

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return replace_column(df, self.column, self.cell(df, ctx))


# ---------------------------------------------------------------- columns


@dataclass(frozen=True)
class Cast(Step):
    """Convert a column; temporal targets may name patterns that are tried in order."""

    column: str
    to_type: str
    formats: str | tuple[str, ...] = ()
    impact: ClassVar[str] = "cast"
    kind: ClassVar[str] = "cast"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.to_type)

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        target = self.to_type.upper()
        formats = casts.pattern_list(self.formats)
        if target in casts.TEMPORAL_TARGETS and formats:
            parsed = casts.parse_temporal(text_of(df, self.column), formats)
            return casts.temporal_target(parsed, target)
        if target == "VARCHAR":
            return text_of(df, self.column)
        return casts.convert(col(self.column), df.schema[self.column].dataType, target)


@dataclass(frozen=True)
class Trim(Step):
    """Trim and fold runs of white space to one blank."""

    column: str
    impact: ClassVar[str] = "cell"
    kind: ClassVar[str] = "trim"

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        return F.regexp_replace(F.trim(text_of(df, self.column)), r"\s+", " ")


@dataclass(frozen=True)
class Case(Step):
    column: str
    mode: str = "upper"
    impact: ClassVar[str] = "cell"
    kind: ClassVar[str] = "case"

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        return (F.lower if self.mode == "lower" else F.upper)(text_of(df, self.column))


@dataclass(frozen=True)
class RegexReplace(Step):
    column: str
    pattern: str
    replacement: str = ""
    every: bool = True
    ignore_case: bool = False
    impact: ClassVar[str] = "cell"
    kind: ClassVar[str] = "regexReplace"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.pattern)

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        return patterns.regex_replace(
            text_of(df, self.column), self.pattern, self.replacement, self.every, self.ignore_case
        )


@dataclass(frozen=True)
class RegexExtract(Step):
    column: str
    pattern: str
    group: int = 0
    ignore_case: bool = False
    impact: ClassVar[str] = "extract"
    kind: ClassVar[str] = "regexExtract"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.pattern)

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        text = text_of(df, self.column)
        return patterns.regex_extract(text, self.pattern, self.group, self.ignore_case)


@dataclass(frozen=True)
class ParseNumber(Step):
    column: str
    decimal: str = ","
    target: str = "DOUBLE"
    impact: ClassVar[str] = "cast"
    kind: ClassVar[str] = "parseNumber"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.target)

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        return casts.parse_number(text_of(df, self.column), self.decimal, self.target)


@dataclass(frozen=True)
class ParseDate(Step):
    """Text to date or time; `generalize` cuts to month, quarter or year."""

    column: str
    target: str = "DATE"
    formats: str | tuple[str, ...] = ()
    generalize: str = "none"
    impact: ClassVar[str] = "cast"
    kind: ClassVar[str] = "parseDate"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.target)

    @property
    def anonymises(self) -> bool:
        return self.generalize not in ("", "none")

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        formats = casts.pattern_list(self.formats)
        if formats:
            parsed = casts.parse_temporal(text_of(df, self.column), formats)
        else:
            dtype = df.schema[self.column].dataType
            parsed = casts.convert(col(self.column), dtype, "TIMESTAMP")
        if self.anonymises:
            parsed = F.date_trunc(self.generalize, parsed).cast("timestamp_ntz")
        return casts.temporal_target(parsed, self.target)


@dataclass(frozen=True)
class EmptyToNull(Step):
    column: str
    impact: ClassVar[str] = "cell"
    kind: ClassVar[str] = "emptyToNull"

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        return F.nullif(F.trim(text_of(df, self.column)), F.lit(""))


@dataclass(frozen=True)
class NumRound(Step):
    """Round to a multiple of `step`."""

    column: str
    step: float
    impact: ClassVar[str] = "cast"
    kind: ClassVar[str] = "numRound"

    @property
    def complete(self) -> bool:
        return bool(self.column) and self.step > 0

    @property
    def anonymises(self) -> bool:
        return True

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        k = F.lit(float(self.step))
        return F.round(number_of(df, self.column) / k) * k


@dataclass(frozen=True)
class NumNoise(Step):
    """Add noise of up to +-amount, or multiply by 1 +- amount when relative."""

    column: str
    amount: float
    mode: str = "det"
    relative: bool = False
    whole: bool = False
    impact: ClassVar[str] = "cast"
    kind: ClassVar[str] = "numNoise"

    @property
    def complete(self) -> bool:
        return bool(self.column) and self.amount > 0

    @property
    def random(self) -> bool:
        return self.mode == "rand"

    @property
    def anonymises(self) -> bool:
        return True

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        base = number_of(df, self.column)
        if self.random:
            step = random_unit(ctx.row_key(df), ctx.seed_for(self.column)) * 2 - 1
        else:
            step = unit(text_of(df, self.column), ctx.salt)
        amount = F.lit(float(self.amount))
        value = base * (1 + step * amount) if self.relative else base + step * amount
        return F.round(value).cast("bigint") if self.whole else F.round(value, 2)


@dataclass(frozen=True)
class NumRandom(Step):
    """Replace by a uniform draw from [min, max]; NULL stays."""

    column: str
    min: float
    max: float
    whole: bool = False
    impact: ClassVar[str] = "cell"
    kind: ClassVar[str] = "numRandom"

    @property
    def complete(self) -> bool:
        return bool(self.column) and self.min is not None and self.max is not None

    @property
    def random(self) -> bool:
        return True

    @property
    def anonymises(self) -> bool:
        return True

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        drawn = random_unit(ctx.row_key(df), ctx.seed_for(self.column))
        value = F.lit(float(self.min)) + drawn * float(self.max - self.min)
        value = F.round(value).cast("bigint") if self.whole else F.round(value, 2)
        return F.when(col(self.column).isNotNull(), value)


@dataclass(frozen=True)
class Rename(Step):
    column: str
    new_name: str
    kind: ClassVar[str] = "rename"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.new_name.strip())

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return df.withColumnRenamed(self.column, self.new_name.strip())


@dataclass(frozen=True)
class Drop(Step):
    column: str
    kind: ClassVar[str] = "drop"

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return df.drop(self.column)


# ---------------------------------------------------------------- pseudonyms


@dataclass(frozen=True)
class Hash(Step):
    """SHA-256 of value and salt; NULL stays NULL."""

    column: str
    impact: ClassVar[str] = "cell"
    kind: ClassVar[str] = "hash"

    @property
    def anonymises(self) -> bool:
        return True

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        text = text_of(df, self.column)
        return F.sha2(F.concat(text, F.lit(ctx.salt)) if ctx.salt else text, 256)


@dataclass(frozen=True)
class Synth(Step):
    """Synthetic values: det and rand work per cell, consistent per entity."""

    column: str
    category: str = "fullName"
    method: str = "det"
    k: int = 5
    keep_authorities: bool = False
    kind: ClassVar[str] = "synth"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.category)

    @property
    def consistent(self) -> bool:
        if self.category == "autoEntity":
            return True
        return self.method == "consistent" and self.category in synth.CONSISTENT

    @property
    def impact(self) -> str:  # type: ignore[override]
        return "pseudo" if self.consistent else "cell"

    @property
    def wide(self) -> bool:
        return self.consistent

    @property
    def random(self) -> bool:
        return self.method == "rand" and not self.consistent

    @property
    def anonymises(self) -> bool:
        return True

    def cell(self, df: DataFrame, ctx: Context) -> Column:
        if self.random:
            source = synth.randomly(ctx.row_key(df), ctx.seed_for(self.column))
        else:
            source = synth.deterministic(text_of(df, self.column), ctx.salt)
        return F.when(col(self.column).isNotNull(), synth.synthetic(self.category, source))

    def mapping(self, df: DataFrame, ctx: Context) -> DataFrame:
        return synth.entity_map(
            df, self.column, self.category, self.k, ctx.salt, self.keep_authorities
        )

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not self.consistent:
            return super().apply(df, ctx)
        return synth.apply_map(df, self.column, self.mapping(df, ctx), "pseud", "cnt")


@dataclass(frozen=True)
class Shuffle(Step):
    """Replace each value by one drawn from the column's own values; NULL stays.

    det: the draw depends on the value, so equal values stay equal.  rand: a
    draw per row.  The pool is kept as (value, count, start) and never
    gathered: a draw is a position, found by interval lookup.
    """

    column: str
    mode: str = "det"
    impact: ClassVar[str] = "shuffle"
    kind: ClassVar[str] = "shuffle"

    @property
    def wide(self) -> bool:
        return True

    @property
    def random(self) -> bool:
        return self.mode == "rand"

    @property
    def anonymises(self) -> bool:
        return True

    def pool(self, df: DataFrame) -> DataFrame:
        """(v, cnt, _start) in hash order."""
        counted = df.where(col(self.column).isNotNull()).groupBy(col(self.column).alias("v"))
        counted = counted.agg(F.count(F.lit(1)).alias("cnt"))
        hashed = counted.withColumn("_hash", F.md5(text_of(counted, "v")))
        return hash_order(hashed, "_hash", "v", weight="cnt").select("v", "cnt", "_start")

    @staticmethod
    def _sizes(pool: DataFrame, per_row: bool = False) -> tuple[Column, Column]:
        """Rows in the pool, and the length of a lookup block.

        A block holds about 16 values.  Lookups per row get at least 65536
        blocks, so that a column with few values still fills many tasks.
        """
        total, values = F.sum("cnt"), F.count(F.lit(1))
        block = F.floor(total * 16 / values)
        if per_row:
            block = F.least(block, F.ceil(total / ROW_BLOCKS))
        return (
            pool.agg(F.coalesce(total, F.lit(0))).scalar(),
            pool.agg(F.greatest(F.lit(1), block).cast("bigint")).scalar(),
        )

    def mapping(self, df: DataFrame, ctx: Context) -> DataFrame:
        """det mode: (v, cnt, new), looked up once per distinct value."""
        pool = self.pool(df)
        total, block = self._sizes(pool)
        draws = pool.select(
            F.col("v").alias("_old"),
            F.col("cnt").alias("_weight"),
            draw(text_of(pool, "v"), total, ctx.salt).alias("_draw"),
        )
        hit = interval_lookup(draws, "_draw", pool, "_start", "cnt", block)
        return hit.select(F.col("_old").alias("v"), F.col("_weight").alias("cnt"), F.col("v").alias("new"))

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not self.random:
            return synth.apply_map(df, self.column, self.mapping(df, ctx), "new", "cnt")
        keyed = df if ROW_KEY in df.columns else ctx.with_row_key(df)
        return shuffle_rows(keyed, [self], ctx).select(*[col(c) for c in df.columns])


def shuffle_rows(df: DataFrame, steps: list[Shuffle], ctx: Context) -> DataFrame:
    """Random shuffles of several columns: draw all positions, write them out once, look up.

    The rows are read twice by each lookup, which the written copy makes cheap.
    """
    names = df.columns
    key = ctx.row_key(df)
    pools = [s.pool(df) for s in steps]
    sizes = [s._sizes(p, per_row=True) for s, p in zip(steps, pools)]
    drawn = df.withColumns(
        {
            f"_draw{i}": F.when(
                col(s.column).isNotNull(),
                random_draw(key, total, ctx.seed_for(s.column)),
            )
            for i, (s, (total, _)) in enumerate(zip(steps, sizes))
        }
    )
    out = settle(drawn)
    for i, (step, pool, (_, block)) in enumerate(zip(steps, pools, sizes)):
        known = out.where(F.col(f"_draw{i}").isNotNull())
        hit = interval_lookup(known, f"_draw{i}", pool, "_start", "cnt", block)
        kept = [c for c in out.columns if c != f"_draw{i}"]
        replaced = hit.select(
            *[F.col("v").alias(c) if c == step.column else col(c) for c in kept]
        )
        absent = out.where(F.col(f"_draw{i}").isNull()).select(*[col(c) for c in kept])
        out = replaced.unionByName(absent)
    return out.select(*[col(c) for c in names])


# ---------------------------------------------------------------- amounts


@dataclass(frozen=True)
class Coarsen(Step):
    """Round to multiples of `step` and keep each group's sum.

    The row with the largest absolute value takes the difference; ties go to
    the lowest key.  `key` names unique columns; without one, rows are
    numbered first.
    """

    column: str
    step: float
    group_by: str | None = None
    key: tuple[str, ...] = ()
    impact: ClassVar[str] = "coarsen"
    kind: ClassVar[str] = "coarsen"

    @property
    def complete(self) -> bool:
        return bool(self.column) and self.step > 0

    @property
    def wide(self) -> bool:
        return True

    @property
    def anonymises(self) -> bool:
        return True

    def rounded(self, df: DataFrame) -> Column:
        k = F.lit(float(self.step))
        return F.round(number_of(df, self.column) / k) * k

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        rows = df if self.key else with_row_id(df)
        key = list(self.key) or ["_row_id"]
        grouped = self.group_by not in (None, "", "none")
        group = col(self.group_by) if grouped else F.lit(1)
        base = number_of(df, self.column)
        rows = rows.withColumns({"_base": base, "_rounded": self.rounded(df)})
        id_of = F.struct(*[col(k) for k in key])
        # exact sums: cents as decimals, so the order of adding does not matter
        cents = "decimal(38,6)"
        fixes = rows.groupBy(group.alias("_group")).agg(
            (F.sum(F.col("_base").cast(cents)) - F.sum(F.col("_rounded").cast(cents)))
            .cast("double")
            .alias("_diff"),
            F.min(
                F.when(
                    F.col("_base").isNotNull(),
                    F.struct((-F.abs("_base")).alias("size"), id_of.alias("id")),
                )
            ).alias("_top"),
        )
        # one row per group, met by its key: no row of the group moves for it
        fixes = fixes.where(F.col("_top").isNotNull()).select(
            *[F.col("_top.id").getField(k).alias(f"_id{i}") for i, k in enumerate(key)], "_diff"
        )
        same = all_of([col(k) == F.col(f"_id{i}") for i, k in enumerate(key)])
        fixed = rows.join(fixes, same, "left")
        value = F.round(F.col("_rounded") + F.coalesce(F.col("_diff"), F.lit(0.0)), 2)
        return fixed.select(*[value.alias(c) if c == self.column else col(c) for c in df.columns])


@dataclass(frozen=True)
class RecalcBalance(Step):
    """Opening plus running sum of the amounts in the order of a column.

    `tie_break` makes the order unique; without it, rows are numbered first.
    """

    column: str
    amount_col: str
    order_by: str
    opening: float = 0
    tie_break: tuple[str, ...] = ()
    kind: ClassVar[str] = "recalcSaldo"

    @property
    def complete(self) -> bool:
        return bool(self.column and self.amount_col)

    @property
    def wide(self) -> bool:
        return True

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        rows = df if self.tie_break else with_row_id(df)
        order = [self.order_by, *(self.tie_break or ["_row_id"])]
        amount = number_of(df, self.amount_col).cast("decimal(38,6)")
        summed = running_sum(rows, amount, order, "_sum")
        opening = F.lit(self.opening).cast("decimal(18,6)")
        balance = F.round(F.col("_sum") + opening, 2).cast("double")
        return summed.select(
            *[balance.alias(c) if c == self.column else col(c) for c in df.columns],
            *([] if self.column in df.columns else [balance.alias(self.column)]),
        )


# ---------------------------------------------------------------- rows


@dataclass(frozen=True)
class DedupExact(Step):
    impact: ClassVar[str] = "rows"
    kind: ClassVar[str] = "dedupExact"

    @property
    def complete(self) -> bool:
        return True

    @property
    def wide(self) -> bool:
        return True

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return df.distinct()


@dataclass(frozen=True)
class DedupKeys(Step):
    """First or last row per key in the order of a column; `tie_break` settles equal ones.

    NULL keys form one group.  Spark limits each task to one row per key
    before the shuffle, so a hot key does not reach one task whole.
    """

    keys: tuple[str, ...]
    keep: str = "first"
    order_by: str = ""
    tie_break: tuple[str, ...] = ()
    impact: ClassVar[str] = "rows"
    kind: ClassVar[str] = "dedupKeys"

    @property
    def complete(self) -> bool:
        return bool(self.keys)

    @property
    def wide(self) -> bool:
        return True

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        order = []
        if self.order_by:
            c = col(self.order_by)
            order.append(c.desc_nulls_last() if self.keep == "last" else c.asc_nulls_last())
        order += [col(c) for c in self.tie_break or df.columns]
        ranked = Window.partitionBy(*[col(k) for k in self.keys]).orderBy(*order)
        return df.withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class DropNulls(Step):
    """Keep rows whose listed columns are all filled (and not blank)."""

    cols: tuple[str, ...]
    empty_too: bool = True
    impact: ClassVar[str] = "rows"
    kind: ClassVar[str] = "dropNulls"

    @property
    def complete(self) -> bool:
        return bool(self.cols)

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        keep = [col(c).isNotNull() for c in self.cols]
        if self.empty_too:
            keep += [F.trim(text_of(df, c)) != "" for c in self.cols]
        return df.where(all_of(keep))


@dataclass(frozen=True)
class Filter(Step):
    where: str
    impact: ClassVar[str] = "rows"
    kind: ClassVar[str] = "filter"

    @property
    def complete(self) -> bool:
        return bool(self.where.strip())

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return df.where(self.where)


def date_formats(df: DataFrame, column: str) -> DataFrame:
    """(format, count): how the dates in a text column are written."""
    text = F.trim(text_of(df, column))
    return (
        df.where(col(column).isNotNull())
        .groupBy(F.coalesce(date_format_of(text), F.lit("other")).alias("format"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


# Date notations, checked in this order.
DATE_NOTATIONS = (
    ("YYYY-MM-DD HH:mm:ss", r"\A\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}"),
    ("YYYY-MM-DD", r"\A\d{4}-\d{1,2}-\d{1,2}\z"),
    ("DD.MM.YYYY", r"\A\d{1,2}\.\d{1,2}\.\d{2,4}\z"),
    ("MM/DD/YYYY", r"\A\d{1,2}/\d{1,2}/\d{2,4}\z"),
)


def date_format_of(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in DATE_NOTATIONS])
