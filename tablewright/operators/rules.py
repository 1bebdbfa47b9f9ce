"""Data-quality rules: one pass over the table, NULL passes every check but not_null."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.casts import TARGET_TYPES, convert
from tablewright.functions.columns import all_of, any_of, categories, col, number_of, text_of
from tablewright.functions.masks import mask
from tablewright.functions.patterns import full_match
from tablewright.operators.distributed import lookup_join
from tablewright.operators.patterns import dominant_masks, dominant_masks_of

KEYED = ("unique", "reference")


@dataclass(frozen=True)
class Rule:
    """One check.  Which fields count depends on `type`:

    not_null, unique (col or cols), allowed (values), range (min, max,
    exclusive), length (min, max), regex (pattern), pattern (mode), castable
    (as_type), trimmed, reference (ref, ref_col), sql (expr is true for a
    breaking row), row_count (min, max).
    """

    type: str
    col: str | None = None
    cols: tuple[str, ...] = ()
    values: tuple[Any, ...] = ()
    min: Any = None
    max: Any = None
    exclusive: bool = False
    pattern: str = ""
    mode: str = "exact"
    as_type: str = "VARCHAR"
    ref: DataFrame | None = field(default=None, compare=False)
    ref_col: str | None = None
    expr: str = ""
    label: str | None = None
    severity: str = "error"
    masks: tuple[str, ...] | None = None

    @property
    def keys(self) -> list[str]:
        return list(self.cols) if self.cols else [self.col]

    @property
    def is_error(self) -> bool:
        return self.severity != "warning"


def load_rules(
    document: str | dict | list, tables: dict[str, DataFrame] | None = None
) -> list[Rule]:
    """Rules from a JSON document {version, source, rules} or a bare list.

    `tables` names the DataFrames that reference rules point at (`refFrom`).
    """
    data = json.loads(document) if isinstance(document, str) else document
    items = data["rules"] if isinstance(data, dict) else data
    if not isinstance(items, list):
        raise ValueError("a ruleset is a list of rules")
    out = []
    for item in items:
        item = dict(item)
        source = item.pop("refFrom", None)
        fields = {
            "as_type": item.pop("as", "VARCHAR"),
            "ref_col": item.pop("refCol", None),
            "cols": tuple(item.pop("cols", None) or ()),
            "values": tuple(item.pop("values", None) or ()),
            "ref": (tables or {})[source] if source else None,
        }
        known = {k: v for k, v in item.items() if k in Rule.__dataclass_fields__}
        out.append(Rule(**{**fields, **known}))
    return out


def dump_rules(rules: list[Rule], source: str = "") -> str:
    """The ruleset document of `rules`."""
    names = {"as_type": "as", "ref_col": "refCol"}
    items = []
    for rule in rules:
        item = {}
        for name, spec in Rule.__dataclass_fields__.items():
            value = getattr(rule, name)
            if name in ("ref", "masks") or value == spec.default or value in (None, ()):
                continue
            item[names.get(name, name)] = list(value) if isinstance(value, tuple) else value
        items.append({"type": rule.type, "severity": rule.severity, **item})
    return json.dumps({"version": 1, "source": source, "rules": items}, ensure_ascii=False)


def _is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def typed_values(df: DataFrame, rule: Rule) -> Rule:
    """List values become numbers where the column holds numbers."""
    if rule.type != "allowed" or categories(df).get(rule.col) not in ("integer", "numeric"):
        return rule
    return replace(rule, values=tuple(float(v) if isinstance(v, str) else v for v in rule.values))


def resolve(df: DataFrame, rule: Rule) -> Rule:
    """A pattern rule learns its masks from the data (one small job); others stay as they are."""
    if rule.type == "pattern" and rule.masks is None:
        return replace(rule, masks=tuple(dominant_masks(df, rule.col, rule.mode == "compact")))
    return typed_values(df, rule)


def is_skipped(rule: Rule) -> bool:
    return rule.type == "pattern" and not rule.masks


def violation(df: DataFrame, rule: Rule) -> Column:
    """True for a breaking row; never NULL.  For rules that look at one row only."""
    c = col(rule.col) if rule.col else None
    if rule.type == "not_null":
        return c.isNull()
    if rule.type == "sql":
        return F.coalesce(F.expr(f"({rule.expr})"), F.lit(False))
    if rule.type == "allowed":
        if not rule.values:
            return F.lit(True)
        left = number_of(df, rule.col) if any(map(_is_number, rule.values)) else c
        good = left.isin(*rule.values)
    elif rule.type == "range":
        numeric = _is_number(rule.min) or _is_number(rule.max)
        left = number_of(df, rule.col) if numeric else c
        parts = []
        if rule.min is not None:
            parts.append(left > rule.min if rule.exclusive else left >= rule.min)
        if rule.max is not None:
            parts.append(left < rule.max if rule.exclusive else left <= rule.max)
        good = all_of(parts)
    elif rule.type == "length":
        size = F.char_length(text_of(df, rule.col))
        parts = [size >= int(rule.min)] if rule.min is not None else []
        parts += [size <= int(rule.max)] if rule.max is not None else []
        good = all_of(parts)
    elif rule.type == "regex":
        good = full_match(text_of(df, rule.col), rule.pattern)
    elif rule.type == "pattern":
        good = mask(text_of(df, rule.col), rule.mode == "compact").isin(list(rule.masks or ()))
    elif rule.type == "castable":
        target = rule.as_type.upper() if rule.as_type.upper() in TARGET_TYPES else "VARCHAR"
        good = convert(c, df.schema[rule.col].dataType, target).isNotNull()
    elif rule.type == "trimmed":
        text = text_of(df, rule.col)
        good = text == F.trim(text)
    else:
        raise ValueError(f"no row check for rule type {rule.type}")
    # a check that cannot be evaluated is no violation
    return c.isNotNull() & F.coalesce(~good, F.lit(False))


def _reference_keys(rule: Rule) -> DataFrame:
    return rule.ref.select(col(rule.ref_col).alias("_ref")).where("_ref IS NOT NULL").distinct()


def _open_reference(rule: Rule) -> Column:
    """True when the reference list holds a NULL: then no value is provably absent."""
    return rule.ref.select(F.coalesce(F.bool_or(col(rule.ref_col).isNull()), F.lit(False))).scalar()


def breaking_keys(df: DataFrame, rules: list[Rule], prefix: str = "_b") -> DataFrame:
    """Keys that break one of several unique or reference rules on the same key columns.

    Besides the key: `_n` rows that have it, and one boolean column per rule.  The table is read and
    counted once, whatever the number of rules; reference lists meet distinct keys, not rows.
    """
    keys = [col(k) for k in rules[0].keys]
    counted = df.where(all_of([k.isNotNull() for k in keys])).groupBy(*keys)
    counted = _marked(counted.agg(F.count(F.lit(1)).alias("_n")), rules, keys[0], prefix)
    return counted.where(any_of([F.col(f"{prefix}{j}") for j in range(len(rules))]))


def _marked(counted: DataFrame, rules: list[Rule], key: Column, prefix: str) -> DataFrame:
    """Counted keys with a boolean per rule; `key` is the only key column where a rule has a reference list."""
    for j, rule in enumerate(rules):
        if rule.type == "unique":
            counted = counted.withColumn(f"{prefix}{j}", F.col("_n") > 1)
        else:
            known = _reference_keys(rule).withColumn("_known", F.lit(True))
            counted = counted.join(known, key == F.col("_ref"), "left")
            absent = key.isNotNull() & F.col("_known").isNull() & ~_open_reference(rule)
            counted = counted.withColumn(f"{prefix}{j}", absent).drop("_ref", "_known")
    return counted


def _by_keys(rules: list[tuple[int, Rule]]) -> list[list[tuple[int, Rule]]]:
    """Numbered key rules by their key columns, in order of their last rule."""
    groups: dict[tuple[str, ...], list[tuple[int, Rule]]] = {}
    for i, rule in rules:
        group = groups.pop(tuple(rule.keys), [])
        groups[tuple(rule.keys)] = [*group, (i, rule)]
    return list(groups.values())


def flag_rules(df: DataFrame, rules: list[Rule], prefix: str = "_r") -> DataFrame:
    """The table with one boolean column per rule, true where the row breaks it.

    Key rules on the same columns share one lookup of the keys that break any of them.
    """
    out = df.withColumns(
        {
            f"{prefix}{i}": violation(df, r)
            for i, r in enumerate(rules)
            if r.type not in KEYED + ("row_count",) and not is_skipped(r)
        }
    )
    for group in _by_keys([(i, r) for i, r in enumerate(rules) if r.type in KEYED]):
        keys = breaking_keys(df, [r for _, r in group])
        out = lookup_join(out, group[0][1].keys, keys, "_n").drop("_hit")
        flags = {
            f"{prefix}{i}": F.coalesce(F.col(f"_b{j}"), F.lit(False)) for j, (i, _) in enumerate(group)
        }
        out = out.withColumns(flags).drop(*[f"_b{j}" for j in range(len(group))])
    return out


def _counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: total, invalid and v<i> per rule, from one pass.

    The last key rules, those on one set of columns, are folded into the pass: rows are added up per
    key, so no row is joined back for them and a hot key shrinks before the shuffle.
    """
    active = [
        (i, r) for i, r in enumerate(rules) if r.type != "row_count" and not is_skipped(r)
    ]
    keyed = _by_keys([(i, r) for i, r in active if r.type in KEYED])
    folded = keyed[-1] if keyed else []
    inside = [i for i, _ in folded]
    plain = [(i, r) for i, r in active if i not in inside]
    joined = [r if i not in inside else Rule("row_count") for i, r in enumerate(rules)]
    flagged = flag_rules(df, joined)
    broken = any_of([F.col(f"_r{i}") for i, r in plain if r.is_error])
    sums = [F.count(F.lit(1)).alias("total"), F.count_if(broken).alias("invalid")]
    sums += [F.count_if(F.col(f"_r{i}")).alias(f"v{i}") for i, _ in plain]
    if not folded:
        return flagged.agg(*sums)

    group = [r for _, r in folded]
    keys = [f"_k{i}" for i in range(len(group[0].keys))]
    per_key = flagged.groupBy(*[col(k).alias(a) for k, a in zip(group[0].keys, keys)]).agg(*sums)
    per_key = _marked(per_key.withColumn("_n", F.col("total")), group, F.col("_k0"), "_b")
    known = all_of([F.col(k).isNotNull() for k in keys])
    bad = [known & F.col(f"_b{j}") for j in range(len(group))]
    hurt = F.when(any_of([b for b, r in zip(bad, group) if r.is_error]), F.col("total"))
    return per_key.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(hurt.otherwise(F.col("invalid"))), F.lit(0)).alias("invalid"),
        *[F.coalesce(F.sum(f"v{i}"), F.lit(0)).alias(f"v{i}") for i, _ in plain],
        *[
            F.coalesce(F.sum(F.when(b, F.col("total"))), F.lit(0)).alias(f"v{i}")
            for b, i in zip(bad, inside)
        ],
    )


def validate(df: DataFrame, rules: list[Rule] | list[dict] | str | dict) -> DataFrame:
    """One row per rule, with the table's figures repeated on each.

    Columns: rule_no, type, target, severity, status (pass, fail, warn,
    skipped), violations, share, actual (row_count only), total, invalid,
    valid, score, ok.  `invalid` counts rows that break at least one error
    rule.
    """
    if not (isinstance(rules, list) and all(isinstance(r, Rule) for r in rules)):
        rules = load_rules(rules)
    rules = [resolve(df, r) for r in rules]
    counts = _counts(df, rules)
    total = F.col("total")
    entries = []
    for i, rule in enumerate(rules):
        table_level = rule.type == "row_count"
        if table_level:
            inside = all_of(
                ([total >= rule.min] if rule.min is not None else [])
                + ([total <= rule.max] if rule.max is not None else [])
            )
            hits = F.when(inside, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
            share = F.lit(0.0)
        elif is_skipped(rule):
            hits, share = F.lit(0).cast("bigint"), F.lit(0.0)
        else:
            hits = F.col(f"v{i}").cast("bigint")
            share = F.when(total > 0, hits / total).otherwise(F.lit(0.0))
        status = F.when(hits > 0, "fail" if rule.is_error else "warn").otherwise("pass")
        entries.append(
            F.struct(
                F.lit(i).cast("bigint").alias("rule_no"),
                F.lit(rule.type).alias("type"),
                F.lit(rule.label or ", ".join(k for k in rule.keys if k)).alias("target"),
                F.lit("error" if rule.is_error else "warning").alias("severity"),
                (F.lit("skipped") if is_skipped(rule) else status).alias("status"),
                hits.alias("violations"),
                share.alias("share"),
                (total if table_level else F.lit(None)).cast("bigint").alias("actual"),
            )
        )
    results = F.array(*entries)
    return counts.select(
        results.alias("results"),
        total.cast("bigint").alias("total"),
        F.col("invalid").cast("bigint").alias("invalid"),
    ).select(
        F.inline("results"),
        "total",
        "invalid",
        (F.col("total") - F.col("invalid")).alias("valid"),
        F.when(F.col("total") > 0, (F.col("total") - F.col("invalid")) / F.col("total"))
        .otherwise(F.lit(1.0))
        .alias("score"),
        (~F.exists("results", lambda r: r["status"] == "fail")).alias("ok"),
    )


def summary(report: DataFrame) -> DataFrame:
    """The table line of a validate() report: total, valid, invalid, score, ok."""
    return report.where("rule_no = 0").select("total", "valid", "invalid", "score", "ok")


STATUS_SIGNS = {"pass": "✓", "fail": "✗", "warn": "⚠", "skipped": "–"}


def report_document(report: DataFrame, title: str = "Validation report") -> DataFrame:
    """(line_no, value): a validate() report as a Markdown text, the table's figures and a line per rule.

    A rule's line holds its violations, for row_count the number of rows.
    """
    total, valid, invalid = (F.col(c).cast("string") for c in ("total", "valid", "invalid"))
    score = F.format_string("%.1f", F.col("score") * 100)
    head = [
        F.lit(f"# {title}"), F.lit(""),
        F.concat(F.lit("- Rows: "), total),
        F.concat(F.lit("- Score: "), score, F.lit(" % · "), valid, F.lit("/"), total, F.lit(" valid · "),
                 invalid, F.lit(" with violations")),
        F.lit(""), F.lit("| Rule | Status | Violations |"), F.lit("|---|---|---|"),
    ]
    cells = [F.struct(F.lit(i).cast("bigint").alias("line_no"), c.alias("value")) for i, c in enumerate(head, 1)]
    target = F.replace("target", F.lit("|"), F.lit("\\|"))
    label = F.concat("type", F.when(target != "", F.concat(F.lit(" `"), target, F.lit("`"))).otherwise(""))
    sign = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STATUS_SIGNS.items()])
    line = F.concat_ws(" | ", label, sign, F.coalesce("actual", "violations").cast("string"))
    rules = report.select(
        (F.col("rule_no") + len(head) + 1).alias("line_no"), F.concat(F.lit("| "), line, F.lit(" |")).alias("value")
    )
    top = report.where("rule_no = 0").select(F.inline(F.array(*cells)))
    return top.unionByName(rules).orderBy("line_no")


def violating_rows(df: DataFrame, rule: Rule) -> DataFrame:
    """All rows that break the rule."""
    rule = resolve(df, rule)
    if rule.type == "row_count" or is_skipped(rule):
        return df.where(F.lit(False))
    if rule.type in KEYED:
        hit = lookup_join(df, rule.keys, breaking_keys(df, [rule]), "_n")
        return hit.where("_hit").drop("_hit", "_b0")
    return df.where(violation(df, rule))


def sample_violations(
    df: DataFrame, rule: Rule, limit: int = 20, order_by: list[str] | None = None
) -> DataFrame:
    """A sample of the breaking rows; with `order_by` always the same ones."""
    rows = violating_rows(df, rule)
    return (rows.orderBy(*[col(c) for c in order_by]) if order_by else rows).limit(limit)


def suggest(df: DataFrame) -> list[Rule]:
    """Rules that the table meets today.

    Eager: profile figures per column, then values or masks of the text
    columns that need them.
    """
    from tablewright.operators.profile import distinct_counts

    kinds = categories(df)
    names = [n for n, k in kinds.items() if k != "complex"]
    stats = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[
            f(col(n)).cast("double").alias(f"{tag}{i}")
            for i, n in enumerate(names)
            if kinds[n] in ("integer", "numeric")
            for f, tag in ((F.min, "lo"), (F.max, "hi"))
        ],
    ).first()
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(df).collect()}
    few = [
        n
        for i, n in enumerate(names)
        if kinds[n] in ("string", "binary", "other") and 0 < distinct[n] <= 12
        and distinct[n] < stats[f"n{i}"]
    ]
    values: dict[str, list] = {}
    if few:
        row = df.agg(*[F.sort_array(F.collect_set(col(n))) for n in few]).first()
        values = dict(zip(few, row))
    masked = dominant_masks_of(
        df,
        {
            n: stats[f"n{i}"]
            for i, n in enumerate(names)
            if kinds[n] in ("string", "binary", "other") and distinct[n] > 12 and n not in values
        },
    )
    out = []
    for i, n in enumerate(names):
        filled, d = stats[f"n{i}"], distinct[n]
        if stats["total"] > 0 and filled == stats["total"]:
            out.append(Rule("not_null", n))
        if d == filled and filled > 1:
            out.append(Rule("unique", n))
        if n in values:
            out.append(Rule("allowed", n, values=tuple(values[n])))
        elif masked.get(n):
            out.append(Rule("pattern", n, masks=tuple(masked[n])))
        if kinds[n] in ("integer", "numeric") and filled:
            out.append(
                Rule("range", n, min=stats[f"lo{i}"], max=stats[f"hi{i}"], severity="warning")
            )
    return out
