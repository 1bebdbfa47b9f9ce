"""An ordered list of steps folded over a DataFrame."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tablewright.operators.steps import ROW_KEY, Context, Shuffle, Step, shuffle_rows


@dataclass(frozen=True)
class Entry:
    """A step in a pipeline, switched on or off."""

    step: Step
    enabled: bool = True

    @property
    def active(self) -> bool:
        return self.enabled and self.step.complete


@dataclass(frozen=True)
class Pipeline:
    """Steps in order, with one salt, one seed and the columns that name a row.

    Row-local steps stay lazy and collapse into one projection.  Random draws
    depend on seed, column and row key; without key columns, rows are numbered
    among their copies before each run of random steps, which costs a shuffle.
    """

    entries: tuple[Entry, ...]
    salt: str = ""
    seed: int = 0
    key: tuple[str, ...] = ()
    context: Context = field(init=False)

    def __init__(self, steps, salt: str = "", seed: int = 0, key: tuple[str, ...] = ()):
        entries = tuple(s if isinstance(s, Entry) else Entry(s) for s in steps)
        object.__setattr__(self, "entries", entries)
        object.__setattr__(self, "salt", salt)
        object.__setattr__(self, "seed", seed)
        object.__setattr__(self, "key", tuple(key))
        object.__setattr__(self, "context", Context(salt, seed, tuple(key)))

    def apply(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """All active steps, or those before position `upto`."""
        entries = [e for e in self.entries[: len(self.entries) if upto is None else upto]]
        active = [e.step for e in entries if e.active]
        i = 0
        while i < len(active):
            step = active[i]
            if step.random and ROW_KEY not in df.columns:
                df = self.context.with_row_key(df)
            elif not step.random and ROW_KEY in df.columns:
                df = df.drop(ROW_KEY)
            if isinstance(step, Shuffle) and step.random:
                run = [step]
                while (
                    i + 1 < len(active)
                    and isinstance(active[i + 1], Shuffle)
                    and active[i + 1].random
                    and active[i + 1].column not in [s.column for s in run]
                ):
                    i += 1
                    run.append(active[i])
                df = shuffle_rows(df, run, self.context)
            else:
                df = step.apply(df, self.context)
            i += 1
        return df.drop(ROW_KEY)

    def signature(self) -> str:
        """Same text for pipelines that do the same."""
        parts = [repr(e.step) for e in self.entries if e.active]
        parts += [self.salt, str(self.seed), *self.key]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()
