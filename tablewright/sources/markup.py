"""Tables inside HTML pages and Markdown texts, one document per row."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import col

register_pickle_by_value(sys.modules[__name__])  # workers need no install

# Named entities that are decoded; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&amp;", "&"),
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _decode_numbers(text: Column) -> Column:
    """&#8211; and &#x2013; as characters."""

    def piece(p: Column, i: Column) -> Column:
        digits = F.regexp_extract(p, r"\A(\d{1,5});", 1)
        hexes = F.regexp_extract(p, r"\A[xX]([0-9a-fA-F]{1,4});", 1)
        code = F.when(digits != "", F.hex(digits.try_cast("bigint"))).otherwise(hexes)
        char = F.decode(F.unhex(F.lpad(code, 4, "0")), "UTF-16BE")
        rest = F.regexp_replace(p, r"\A[^;]*;", "")
        return F.when(i == 0, p).when(code != "", F.concat(char, rest)).otherwise(
            F.concat(F.lit("&#"), p)
        )

    return F.when(
        F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&#"), piece), "")
    ).otherwise(text)


def cell_content(html: Column) -> Column:
    """Text of an HTML fragment: tags gone, entities decoded, white space folded."""
    text = _decode_numbers(F.regexp_replace(html, r"<[^>]*>", ""))
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def extract_html_tables(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_no, name, row_no, col_no, value): every cell of every table of a page.

    Rows without cells and tables without rows are left out; short rows are
    padded with empty text.  A table inside a table cell ends the outer one.
    """
    html = F.regexp_replace(col(html_col), r"(?s)<!--.*?-->", "")
    tables = F.regexp_extract_all(
        html, F.lit(r"(?is)<table\b[^>]*>(.*?)(?=</table\s*>|<table\b|\z)"), F.lit(1)
    )

    def rows_of(table: Column) -> Column:
        rows = F.regexp_extract_all(
            table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|\z)"), F.lit(1)
        )
        cells = F.transform(
            rows,
            lambda r: F.transform(
                F.regexp_extract_all(
                    r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=<t[hd]\b|</t[hd]\s*>|\z)"), F.lit(1)
                ),
                cell_content,
            ),
        )
        return F.filter(cells, lambda r: F.size(r) > 0)

    def one(table: Column) -> Column:
        caption = F.regexp_extract(table, r"(?is)<caption\b[^>]*>(.*?)</caption\s*>", 1)
        return F.struct(cell_content(caption).alias("caption"), rows_of(table).alias("rows"))

    found = df.where(F.contains(F.lower(col(html_col)), F.lit("<table"))).select(
        col(id_col).alias("id"),
        F.filter(F.transform(tables, one), lambda t: F.size(t["rows"]) > 0).alias("tables"),
    )
    per_table = found.select("id", F.posexplode("tables").alias("t", "table"))
    width = F.array_max(F.transform("table.rows", lambda r: F.size(r)))
    name = F.concat(F.lit("Table "), F.col("t") + 1)
    name = F.when(
        F.col("table.caption") != "", F.concat(name, F.lit(" — "), F.col("table.caption"))
    ).otherwise(name)
    per_row = per_table.select(
        "id", (F.col("t") + 1).alias("table_no"), name.alias("name"), width.alias("width"),
        F.posexplode("table.rows").alias("r", "row"),
    )
    padded = F.concat(
        F.col("row"),
        F.array_repeat(F.lit(""), F.col("width") - F.size("row")),
    )
    return per_row.select(
        "id", "table_no", "name", (F.col("r") + 1).alias("row_no"),
        F.posexplode(padded).alias("c", "value"),
    ).select("id", "table_no", "name", "row_no", (F.col("c") + 1).alias("col_no"), "value")


# ---------------------------------------------------------------- Markdown


BLANK = "[ \t\n\x0b\f\r]"
ENDS = re.compile(rf"\A{BLANK}+|{BLANK}+\Z")
HEADING = re.compile(rf"\A{BLANK}{{0,3}}#{{1,6}}{BLANK}+(.*)\Z")
PIPE = re.compile(r"(?<!\\)\|")
RULE = re.compile(r":?-+:?")
ROWS_AT_ONCE = 5_000


def _row_cells(line: str) -> list[str]:
    """Cells of a pipe row; escaped pipes belong to the cell."""
    bare = ENDS.sub("", line).removeprefix("|").removesuffix("|")
    return [ENDS.sub("", re.sub(r"\\([|\\])", r"\1", c)) for c in PIPE.split(bare)]


def _is_separator(line: str) -> bool:
    return "-" in line and all(
        RULE.fullmatch(re.sub(f"{BLANK}+", "", c)) for c in _row_cells(line)
    )


def _unique_names(names: list[str]) -> list[str]:
    """Second and further columns of a name get _2, _3, ...; empty names their position."""
    out: list[str] = []
    taken: set[str] = set()
    following: dict[str, int] = {}
    for i, name in enumerate(names):
        name = wanted = name or f"column{i + 1}"
        while name in taken:
            number = following[wanted] = following.get(wanted, 1) + 1
            name = f"{wanted}_{number}"
        out.append(name)
        taken.add(name)
    return out


def _pipe_tables(text: str) -> Iterator[tuple[str, list[str], list[list[str]]]]:
    """(heading, names, rows) of the tables of a text, in one walk over its lines."""
    lines = re.split(r"\r?\n", text)
    heading, i = "", 0
    while i < len(lines):
        line = lines[i]
        title = HEADING.match(line) if "#" in line else None
        if title:
            heading = ENDS.sub("", re.sub(rf"{BLANK}*#*{BLANK}*\Z", "", title[1]))
        elif "|" in line and i + 1 < len(lines) and _is_separator(lines[i + 1]):
            end = i + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            yield heading, _unique_names(_row_cells(line)), [_row_cells(r) for r in lines[i + 2 : end]]
            heading, i = "", end
            continue
        elif ENDS.sub("", line):
            heading = ""
        i += 1


def extract_markdown_tables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, table_no, name, row_no, col_no, header, value): pipe tables of a text, cell by cell.

    A table is a line with a pipe above a separator line, and ends at a line
    that is blank or has no pipe.  A heading right above names it.  A text is
    walked once, in time in proportion to its length; nothing is shuffled.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for at, text in enumerate(batch["text"].to_pylist()):
                for number, (heading, names, rows) in enumerate(_pipe_tables(text), 1):
                    name = f"Table {number} — {heading}" if heading else f"Table {number}"
                    found += [(at, number, name, names, r, cells) for r, cells in enumerate(rows, 1)]
                    while len(found) >= ROWS_AT_ONCE:
                        yield packed(batch, found[:ROWS_AT_ONCE])
                        del found[:ROWS_AT_ONCE]
            if found:
                yield packed(batch, found)

    def packed(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        at, number, name, names, row, cells = zip(*found)
        texts = pa.list_(pa.string())
        return pa.RecordBatch.from_pydict({
            "id": batch["id"].take(pa.array(at)),
            "table_no": pa.array(number, pa.int32()),
            "name": pa.array(name),
            "names": pa.array(names, texts),
            "row_no": pa.array(row, pa.int32()),
            "cells": pa.array(cells, texts),
        })

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.where(F.contains(col(text_col), F.lit("|")))
    rows = texts.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(
        walk,
        f"id {kind}, table_no int, name string, names array<string>, row_no int, cells array<string>",
    )
    return rows.select(
        "id", "table_no", "name", "row_no", "cells", F.posexplode("names").alias("c", "header")
    ).select(
        "id", "table_no", "name", "row_no", (F.col("c") + 1).alias("col_no"), "header",
        F.coalesce(F.get("cells", F.col("c")), F.lit("")).alias("value"),
    )
