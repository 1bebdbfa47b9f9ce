"""Regular expressions written for first-match-only and 1-based back references."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def java_replacement(replacement: str, shift: int = 0) -> str:
    r"""\1 becomes $1 (moved by `shift`), plain dollar signs are escaped."""
    out, i = [], 0
    while i < len(replacement):
        ch = replacement[i]
        if ch == "\\" and i + 1 < len(replacement):
            nxt = replacement[i + 1]
            out.append(f"${int(nxt) + shift}" if nxt.isdigit() else "\\" + nxt)
            i += 2
            continue
        out.append("\\" + ch if ch in "$\\" else ch)
        i += 1
    return "".join(out)


def shift_references(pattern: str, shift: int) -> str:
    return re.sub(r"\\([1-9])", lambda m: "\\" + str(int(m[1]) + shift), pattern)


def regex_replace(
    text: Column, pattern: str, replacement: str, every: bool = True, ignore_case: bool = False
) -> Column:
    flags = "(?i)" if ignore_case else ""
    if every:
        return F.regexp_replace(text, flags + pattern, java_replacement(replacement))
    # the first match only: group 1 is what stands before it, group 2 the match
    lead = rf"{flags}(?s:\A(.*?))({shift_references(pattern, 2)})"
    return F.regexp_replace(text, lead, "$1" + java_replacement(replacement, 2))


def regex_extract(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """Group of the first match, NULL where nothing matches."""
    full = ("(?i)" if ignore_case else "") + pattern
    return F.when(text.rlike(full), F.regexp_extract(text, full, group))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")
