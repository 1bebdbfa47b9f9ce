"""Steps and rules that look at one row only work on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.operators.rules import KEYED, Rule, flag_rules
from tablewright.plans.pipeline import Pipeline


def clean_stream(stream: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Apply a pipeline without wide steps to a stream (no state, no watermark)."""
    wide = [e.step.kind for e in pipeline.entries if e.active and e.step.wide]
    if wide:
        raise ValueError(f"needs the whole table: {', '.join(wide)}")
    return pipeline.apply(stream)


def flag_stream(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """One boolean column per rule on a stream; key rules, and patterns without masks, need a table."""
    for rule in rules:
        if rule.type in KEYED + ("row_count",) or (rule.type == "pattern" and rule.masks is None):
            raise ValueError(f"needs the whole table: {rule.type}")
    return flag_rules(stream, rules)
