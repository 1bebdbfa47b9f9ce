"""Protection levels: which step hides which column.

Level 1 hides direct identifiers and sensitive fields, level 2 also
quasi-identifiers and measures, level 3 draws everything at random.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tablewright.operators import steps as S
from tablewright.operators.scan import (
    WHOLE_TABLE,
    ColumnMeta,
    Suggestion,
    anon_meta,
    scan_clean,
    scan_pii,
)
from tablewright.plans.pipeline import Pipeline


def base_step(kind: str, column: str) -> S.Step:
    """The step for a type of personal data, joins and grouping kept where possible."""
    low = column.lower()
    name = "fullName"
    if re.search("vor|first", low):
        name = "firstName"
    elif re.search("nach|last|sur|familien", low):
        name = "lastName"
    synthetic = {
        "email": "email", "bic": "bic", "iban": "iban", "phone": "phone", "address": "street",
        "zip": "zip", "city": "city", "nationality": "country", "personname": name,
    }
    if kind in synthetic:
        return S.Synth(column, synthetic[kind], "det")
    if kind == "partyname":
        return S.Synth(column, "autoEntity", "consistent", k=5)
    if kind == "birthdate":
        return S.ParseDate(column, "DATE", (), "year")
    if kind in ("gender", "marital", "religion", "political"):
        return S.Shuffle(column, "det")
    if kind in ("age", "income"):
        return S.NumRound(column, 5 if kind == "age" else 1000)
    return S.Hash(column)


def randomised(step: S.Step) -> S.Step:
    """The same protection without any link between equal values."""
    if isinstance(step, S.Synth):
        category = "fullName" if step.category == "autoEntity" else step.category
        return replace(step, category=category, method="rand")
    if isinstance(step, S.ParseDate):
        return step
    return S.Shuffle(step.column, "rand")


@dataclass(frozen=True)
class Findings:
    """What the scans say about a table."""

    cleaning: tuple[Suggestion, ...]
    personal: dict[str, tuple[str, str, str, float]]  # column -> type, level, via, confidence
    meta: ColumnMeta

    def step_for(self, column: str, level: int) -> S.Step | None:
        """The anonymising step of a column at a level, None to keep it."""
        if column in self.personal:
            kind, sensitivity, _, _ = self.personal[column]
            if level < (2 if sensitivity == "quasi" else 1):
                return None
            step = base_step(kind, column)
            return randomised(step) if level >= 3 else step
        if column in self.meta.measures:
            m = self.meta.measures[column]
            if level < 2:
                return None
            if level == 2:
                return S.NumNoise(column, 0.1, "det", relative=True, whole=m.whole)
            return S.NumRandom(column, m.min, m.max, whole=m.whole)
        if column in self.meta.free_text and level >= 3:
            return S.Synth(column, "text", "rand")
        return None


def scan(df: DataFrame) -> Findings:
    """Quality, personal-data and column figures of a table (eager, whole-table passes)."""
    cleaning = scan_clean(df)
    personal = {
        r["column"]: (r["type"], r["level"], r["via"], r["confidence"])
        for r in scan_pii(df).collect()
    }
    return Findings(tuple(cleaning), personal, anon_meta(df, set(personal), cleaning))


def plan(df: DataFrame, level: int, findings: Findings | None = None) -> list[S.Step]:
    """Cleaning steps in their order, then one anonymising step per column.

    Steps on different columns do not depend on each other, so wide ones come
    first and per-row draws last; no drawn value has to be written out twice.
    """
    findings = findings or scan(df)
    cleaning = [s.step for s in sorted(findings.cleaning, key=lambda s: s.order)]
    dropped = {s.column for s in cleaning if isinstance(s, S.Drop)}
    hiding = [findings.step_for(c, level) for c in df.columns if c not in dropped]
    steps = [s for s in hiding if s is not None]
    return cleaning + sorted(steps, key=lambda s: (not s.wide, s.wide and s.random))


def anonymise(
    df: DataFrame,
    level: int,
    salt: str = "",
    seed: int = 0,
    findings: Findings | None = None,
    key: tuple[str, ...] = (),
) -> DataFrame:
    """The table cleaned and protected at a level; `key` names the columns that tell rows apart."""
    return Pipeline(plan(df, level, findings), salt, seed, key).apply(df)


def apply_level(
    pipeline: Pipeline, previous: list[S.Step], df: DataFrame, level: int, findings: Findings
) -> Pipeline:
    """Swap the steps of an earlier level for those of another; own steps stay."""
    old = set(map(repr, previous))
    kept = [e for e in pipeline.entries if repr(e.step) not in old]
    present = {(e.step.kind, getattr(e.step, "column", "")) for e in kept}
    new = [
        s
        for s in plan(df, level, findings)
        if s.anonymises or (s.kind, getattr(s, "column", "")) not in present
    ]
    return Pipeline([*kept, *new], pipeline.salt, pipeline.seed, pipeline.key)


def review(
    df: DataFrame, level: int, findings: Findings | None = None, pipeline: Pipeline | None = None
) -> DataFrame:
    """One row per column that needs attention (and one for the whole table).

    Columns: position, column, type, cleaning, pii_type, pii_level, via,
    confidence, action, handled.
    """
    findings = findings or scan(df)
    done = {repr(e.step) for e in pipeline.entries if e.enabled} if pipeline else set()
    schema = (
        "position bigint, column string, type string, cleaning array<string>, pii_type string, "
        "pii_level string, via string, confidence double, action string, handled boolean"
    )
    rows = []
    for position, name in enumerate([WHOLE_TABLE, *df.columns]):
        cleaning = [s for s in findings.cleaning if s.target == name]
        step = findings.step_for(name, level) if name != WHOLE_TABLE else None
        found = findings.personal.get(name, (None, None, None, None))
        if not (cleaning or step or found[0]):
            continue
        wanted = [repr(s.step) for s in cleaning] + ([repr(step)] if step else [])
        rows.append(
            (
                position, name,
                df.schema[name].dataType.simpleString() if name != WHOLE_TABLE else None,
                [s.kind for s in cleaning], *found, step.kind if step else None,
                all(w in done for w in wanted),
            )
        )
    return df.sparkSession.createDataFrame(rows, schema)
