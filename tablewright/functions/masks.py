"""Value masks: A for upper case, a for lower case, 9 for digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mask symbol, class of characters it stands for, class in the printed regex.
SYMBOLS = (
    ("A", r"\p{Lu}", r"\p{Lu}"),
    ("a", r"\p{Ll}", r"\p{Ll}"),
    ("9", r"[0-9]", r"\d"),
)
META = r"[.*+?^${}()|\[\]\\]"


def mask(text: Column, compact: bool = False) -> Column:
    """The shape of a value; compact folds each run of a class to one symbol."""
    run = "+" if compact else ""
    for symbol, members, _ in SYMBOLS:
        text = F.regexp_replace(text, members + run, symbol)
    return text


def mask_regex(shape: Column, compact: bool = False) -> Column:
    """Anchored regular expression that matches the values behind a mask."""
    runs = F.regexp_extract_all(shape, F.lit("(?s)(A+|a+|9+|.)"), F.lit(1))

    def piece(run: Column) -> Column:
        head = F.substring(run, 1, 1)
        size = F.char_length(run)
        if compact:
            count = F.repeat(F.lit("+"), F.lit(1))
        else:
            count = F.when(size > 1, F.concat(F.lit("{"), size, F.lit("}"))).otherwise("")
        out = F.when(run.rlike(META), F.concat(F.lit("\\"), run)).otherwise(run)
        for symbol, _, printed in SYMBOLS:
            out = F.when(head == symbol, F.concat(F.lit(printed), count)).otherwise(out)
        return out

    return F.concat(F.lit("^"), F.array_join(F.transform(runs, piece), ""), F.lit("$"))


def compact_display(shape: Column) -> Column:
    """Compact mask with a plus after each class symbol."""
    return F.regexp_replace(shape, "([Aa9])", "$1+")
