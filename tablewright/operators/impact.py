"""What a step or a pipeline does to a table: counts, samples, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import col, number_of, replace_column, text_of
from tablewright.operators import steps as S
from tablewright.operators import synth
from tablewright.plans.pipeline import Pipeline

MEASURES = (
    "ok", "failed", "changed", "no_effect", "rows_in", "rows_out", "removed", "entities",
    "collapsed", "total",
)
ROW_LOCAL = ("cast", "extract", "cell")


def _measures(step: S.Step, no: int, source: DataFrame, **values: Column) -> DataFrame:
    """One impact row in the common layout; what a step does not measure is NULL."""
    kind = "pseudo" if step.impact == "pseudo" else step.impact
    return source.select(
        F.lit(no).cast("bigint").alias("step_no"),
        F.lit(step.kind).alias("step"),
        F.lit(kind).alias("kind"),
        *[values.get(m, F.lit(None)).cast("bigint").alias(m) for m in MEASURES],
    )


def _row_local_counts(df: DataFrame, step: S.Step, ctx: S.Context, tag: str) -> list[Column]:
    """Aggregates of a cast, extract or cell step over the table before it."""
    c, after = col(step.column), step.cell(df, ctx)
    if step.impact == "cell":
        before = text_of(df, step.column)
        changed_df = replace_column(df, step.column, after)
        # text of the new value, by its own type
        dtype = changed_df.schema[step.column].dataType
        new = _text_by_type(after, dtype)
        return [F.count_if(~new.eqNullSafe(before)).alias(f"{tag}changed")]
    return [
        F.count_if(c.isNotNull() & after.isNotNull()).alias(f"{tag}ok"),
        F.count_if(c.isNotNull() & after.isNull()).alias(f"{tag}failed"),
        F.count_if(c.isNull()).alias(f"{tag}null"),
    ]


def _text_by_type(c: Column, dtype) -> Column:
    from pyspark.sql import types as T

    from tablewright.functions.columns import COMPLEX_TYPES, double_text

    if isinstance(dtype, COMPLEX_TYPES):
        return F.to_json(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return double_text(c)
    return c.cast("string")


def step_impact(df: DataFrame, step: S.Step, ctx: S.Context, no: int = 0) -> DataFrame:
    """One row of counts for `step` over the table before it."""
    if step.random:
        df = ctx.with_row_key(df)
    total = F.count(F.lit(1))
    if step.impact in ROW_LOCAL:
        counts = df.agg(total.alias("total"), *_row_local_counts(df, step, ctx, ""))
        if step.impact == "cell":
            rest = F.col("total") - F.col("changed")
            return _measures(
                step, no, counts, changed=F.col("changed"), no_effect=rest, total=F.col("total")
            )
        return _measures(
            step, no, counts, ok=F.col("ok"), failed=F.col("failed"), no_effect=F.col("null"),
            total=F.col("total"),
        )
    if step.impact == "rows":
        after = step.apply(df, ctx).agg(F.count(F.lit(1))).scalar()
        counts = df.agg(total.alias("n")).withColumn("m", after)
        return _measures(
            step, no, counts, rows_in=F.col("n"), rows_out=F.col("m"),
            removed=F.col("n") - F.col("m"), total=F.col("n"),
        )
    if step.impact in ("pseudo", "shuffle") and not step.random:
        # the map knows every value with its number of rows: no row is joined
        new = "pseud" if step.impact == "pseudo" else "new"
        mapping = step.mapping(df, ctx)
        moved = ~F.col(new).eqNullSafe(F.col("v"))
        figures = mapping.agg(
            F.count(F.lit(1)).alias("entities"),
            (F.count_if(synth.is_collapsed(step.category)) if new == "pseud" else F.lit(0)).alias(
                "collapsed"
            ),
            F.coalesce(F.sum(F.when(moved, F.col("cnt"))), F.lit(0)).alias("changed"),
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("filled"),
        ).withColumn("total", df.agg(total).scalar())
        nulls = F.col("total") - F.col("filled")
        if new == "pseud":
            return _measures(
                step, no, figures, entities=F.col("entities"), collapsed=F.col("collapsed"),
                changed=F.col("changed"), total=F.col("total"),
            )
        return _measures(
            step, no, figures, changed=F.col("changed"), no_effect=nulls, total=F.col("total")
        )
    if step.impact == "shuffle":
        after = step.apply(df.withColumn("_before", col(step.column)), ctx)
        c = col(step.column)
        counts = after.agg(
            total.alias("total"),
            F.count_if(F.col("_before").isNull()).alias("null"),
            F.count_if(~c.eqNullSafe(F.col("_before"))).alias("changed"),
        )
        return _measures(
            step, no, counts, changed=F.col("changed"), no_effect=F.col("null"),
            total=F.col("total"),
        )
    if step.impact == "coarsen":
        base = number_of(df, step.column)
        counts = df.agg(
            total.alias("total"),
            F.count_if(step.rounded(df) != base).alias("changed"),
            F.count_if(base.isNull()).alias("null"),
        )
        return _measures(
            step, no, counts, changed=F.col("changed"), no_effect=F.col("null"),
            total=F.col("total"),
        )
    return _measures(step, no, df.sparkSession.range(1))


def impact(pipeline: Pipeline, df: DataFrame, index: int) -> DataFrame:
    """Counts of the step at `index`, over the result of the steps before it."""
    step = pipeline.entries[index].step
    return step_impact(pipeline.apply(df, index), step, pipeline.context, index)


def impacts(pipeline: Pipeline, df: DataFrame) -> DataFrame:
    """One row per active step.  Neighbouring row-local steps are counted in one pass."""
    parts: list[DataFrame] = []
    run: list[tuple[int, S.Step]] = []
    aggregates: list[Column] = []
    before = work = df  # `work` carries the counts' columns of the current run

    def flush() -> None:
        nonlocal run, aggregates
        if not run:
            return
        counts = work.agg(F.count(F.lit(1)).alias("total"), *aggregates)
        for no, step in run:
            total = F.col("total")
            if step.impact == "cell":
                changed = F.col(f"s{no}_changed")
                values = {"changed": changed, "no_effect": total - changed, "total": total}
            else:
                values = {
                    "ok": F.col(f"s{no}_ok"),
                    "failed": F.col(f"s{no}_failed"),
                    "no_effect": F.col(f"s{no}_null"),
                    "total": total,
                }
            parts.append(_measures(step, no, counts, **values))
        run, aggregates = [], []

    for no, entry in enumerate(pipeline.entries):
        if not entry.active:
            continue
        step, ctx = entry.step, pipeline.context
        before = work.select(*[c for c in work.columns if not c.startswith("_s")])
        if step.impact in ROW_LOCAL:
            flags = {}
            after = step.cell(before, ctx)
            if step.impact == "cell":
                dtype = replace_column(before, step.column, after).schema[step.column].dataType
                flags[f"_s{no}_changed"] = ~_text_by_type(after, dtype).eqNullSafe(
                    text_of(before, step.column)
                )
            else:
                c = col(step.column)
                flags[f"_s{no}_ok"] = c.isNotNull() & after.isNotNull()
                flags[f"_s{no}_failed"] = c.isNotNull() & after.isNull()
                flags[f"_s{no}_null"] = c.isNull()
            work = work.withColumns({**flags, step.column: after})
            aggregates += [F.count_if(F.col(f)).alias(f[1:]) for f in flags]
            run.append((no, step))
            continue
        flush()
        parts.append(step_impact(before, step, ctx, no))
        work = pipeline.apply(df, no + 1)
    flush()
    if not parts:
        return _measures(S.Drop(""), 0, df.sparkSession.range(0))
    return reduce(DataFrame.unionByName, parts)


def summary(pipeline: Pipeline, df: DataFrame) -> DataFrame:
    """One row: rows and columns before and after, duplicates removed, failed casts,
    anonymised columns."""
    rows = impacts(pipeline, df)
    after = pipeline.apply(df)
    active = [e.step for e in pipeline.entries if e.active]
    anonymised = {s.column for s in active if s.anonymises}
    dedup = F.col("step").isin("dedupExact", "dedupKeys")
    return rows.agg(
        F.coalesce(F.sum(F.when(dedup, F.col("removed"))), F.lit(0)).alias("duplicates_removed"),
        F.coalesce(F.sum(F.when(F.col("step") == "cast", F.col("failed"))), F.lit(0)).alias(
            "cast_failures"
        ),
    ).select(
        df.agg(F.count(F.lit(1))).scalar().alias("rows_before"),
        after.agg(F.count(F.lit(1))).scalar().alias("rows_after"),
        F.lit(len(df.columns)).cast("bigint").alias("columns_before"),
        F.lit(len(after.columns)).cast("bigint").alias("columns_after"),
        "duplicates_removed",
        "cast_failures",
        F.lit(len(anonymised)).cast("bigint").alias("anonymised"),
    )


def diff(
    pipeline: Pipeline,
    df: DataFrame,
    index: int,
    limit: int | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """(order columns, before, after, cls): what one step does to its column, row by row.

    cls: ok, failed (became NULL) or noeffect.  `limit` asks for some rows only.
    """
    step, ctx = pipeline.entries[index].step, pipeline.context
    source = pipeline.apply(df, index)
    name = step.column
    source = source.withColumn("_before", text_of(source, name))
    out = step.apply(source, ctx)
    after = text_of(out, name)
    before = F.col("_before")
    if step.impact in ("cast", "extract"):
        cls = F.when(before.isNull(), "noeffect").when(after.isNull(), "failed").otherwise("ok")
    else:
        cls = F.when(after.eqNullSafe(before), "noeffect").otherwise("ok")
    keys = order_by or []
    rows = out.select(
        *[col(c) for c in keys], before.alias("before"), after.alias("after"), cls.alias("cls")
    )
    rows = rows.orderBy(*[col(c) for c in keys]) if keys else rows
    return rows.limit(limit) if limit else rows


def example(
    df: DataFrame, kind: str, column: str, ctx: S.Context | None = None, limit: int = 4
) -> DataFrame:
    """(before, after): a few distinct pairs of what a step would do to a column.

    Parse steps first count the notations of the whole column.
    """
    from tablewright.operators.scan import decimal_sign, looks_numeric

    ctx = ctx or S.Context()
    known = col(column).isNotNull()
    values = df.where(known).select(text_of(df, column).alias("v"))
    values = values.where(F.trim("v") != "")
    if kind == "parseDate":
        fmt = S.date_format_of(F.trim("v")).alias("f")
        votes = values.select(fmt).where("f IS NOT NULL").groupBy("f").count()
        best = [r["f"] for r in votes.orderBy(F.col("count").desc(), "f").limit(2).collect()]
        target = "TIMESTAMP" if any("HH" in f for f in best) else "DATE"
        step: S.Step = S.ParseDate(column, target, tuple(best))
    elif kind == "parseNumber":
        sign = values.where(looks_numeric(F.col("v"))).agg(decimal_sign(F.col("v"))).first()[0]
        step = S.ParseNumber(column, sign)
    else:
        step = {
            "cast": lambda: S.Cast(column, "BIGINT"),
            "trim": lambda: S.Trim(column),
            "case": lambda: S.Case(column),
            "emptyToNull": lambda: S.EmptyToNull(column),
            "hash": lambda: S.Hash(column),
            "synth": lambda: S.Synth(column),
            "shuffle": lambda: S.Shuffle(column),
            "numRound": lambda: S.NumRound(column, 100),
            "numNoise": lambda: S.NumNoise(column, 1),
            "numRandom": lambda: S.NumRandom(column, 0, 1),
        }[kind]()
    source = df.where(known).withColumn("_before", text_of(df, column))
    out = step.apply(source, ctx)
    pairs = out.select(F.col("_before").alias("before"), text_of(out, column).alias("after"))
    return pairs.distinct().orderBy("before", "after").limit(limit)


def compare(
    before: DataFrame, after: DataFrame, key: list[str], changed_only: bool = False
) -> DataFrame:
    """(key, column, before, after, state): cell by cell, rows met by key.

    state: changed, unchanged, removed (row gone) or added (row new).  Columns
    only the result has compare with NULL.  Tables without a key get one from
    `with_row_id` before the pipeline runs.
    """
    names = [c for c in after.columns if c not in key]
    left = before.select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.struct(
            F.lit(1).alias("_here"),
            *[text_of(before, c).alias(c) for c in names if c in before.columns],
        ).alias("_old"),
    )
    right = after.select(
        *[col(k) for k in key],
        F.struct(F.lit(1).alias("_here"), *[text_of(after, c).alias(c) for c in names]).alias("_new"),
    )
    same = reduce(
        lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(col(k)) for i, k in enumerate(key)]
    )
    joined = left.join(right, same, "full_outer")
    old, new = F.col("_old"), F.col("_new")
    state = F.when(new.isNull(), "removed").when(old.isNull(), "added")
    cells = []
    for c in names:
        b = old.getField(c) if c in before.columns else F.lit(None).cast("string")
        a = new.getField(c)
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                b.alias("before"),
                a.alias("after"),
                state.otherwise(F.when(a.eqNullSafe(b), "unchanged").otherwise("changed")).alias(
                    "state"
                ),
            )
        )
    out = joined.select(
        *[F.coalesce(col(k), F.col(f"_k{i}")).alias(k) for i, k in enumerate(key)],
        F.inline(F.array(*cells)),
    )
    return out.where("state <> 'unchanged'") if changed_only else out
