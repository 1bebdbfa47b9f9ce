"""File lists, file heads and what they reveal: format, row estimate, CSV options.

Executors open each file once and read only its head; all the rest are
expressions over one row per file.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


register_pickle_by_value(sys.modules[__name__])  # workers need no install

HEAD_BYTES = 256 * 1024
DETECT_BYTES = 64 * 1024
DELIMITERS = [",", ";", "\t", "|"]
DELIMITER_LINES = 30
SKIP_LINES = 200
HEADER_LINES = 6
DATE_LINES = 60

# Format by file name ending.
EXTENSIONS = {
    "parquet": "parquet",
    "pq": "parquet",
    "csv": "csv",
    "txt": "csv",
    "tsv": "csv",
    "ndjson": "ndjson",
    "jsonl": "ndjson",
    "html": "html",
    "htm": "html",
    "md": "markdown",
    "markdown": "markdown",
    "mdown": "markdown",
    "mkd": "markdown",
    "xlsx": "xlsx",
    "xls": "xlsx",
    "ods": "xlsx",
    "fods": "xlsx",
    "numbers": "xlsx",
    "sqlite": "sqlite",
    "sqlite3": "sqlite",
    "duckdb": "duckdb",
    "ddb": "duckdb",
}


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes) of files and folders; no file is opened."""
    paths = [paths] if isinstance(paths, str) else paths
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("bytes"))


def spread(files: DataFrame) -> DataFrame:
    """One file per row, evenly over the tasks (a number keeps small rows from being merged)."""
    context = files.sparkSession.sparkContext
    return files.repartition(max(context.defaultParallelism, 8), "path")


def open_file(path: str):
    """An input file of any file system Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _decode(head: bytes) -> tuple[str, bool, str]:
    """(encoding, byte order mark, text); a character cut at the end does not count."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8", True, head[3:].decode("utf-8", "replace")
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16", True, head[: len(head) // 2 * 2].decode("utf-16", "replace")
    for cut in range(4):
        try:
            return "utf-8", False, head[: len(head) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
    return "latin-1", False, head.decode("latin-1")


QUOTED = re.compile(r'(?:(?<=[\n,;\t|])|\A)"(?:[^"]|"")*+(?:"|\Z)')


def _open_in(head: str) -> list[str]:
    """Delimiters under which a line of the head, but for the last, leaves a quoted cell open."""
    lines = [line for line in re.split(r"\r?\n", head)[:-1] if line.count('"') % 2]
    patterns = {d: re.compile(open_quote(d)[:-2] + r"\Z") for d in DELIMITERS}
    return [d for d, p in patterns.items() if any(map(p.search, lines))]


HEAD_SCHEMA = (
    "path string, bytes bigint, magic binary, encoding string, bom boolean, newlines bigint, "
    "head string, open array<string>"
)


def read_heads(files: DataFrame, size: int = DETECT_BYTES, count: int = HEAD_BYTES) -> DataFrame:
    """Decoded first `size` bytes of each file, and line ends in the first `count` bytes."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as f:
                    start = f.read(max(size, count))
                encoding, bom, text = _decode(start[:size])
                left_open = _open_in(text)
                if left_open:  # what follows looks at rows, so cells become one line
                    text = QUOTED.sub(lambda m: re.sub(r"[\r\n]+", " ", m[0]), text)
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [row["path"]],
                        "bytes": pa.array([row["bytes"]], pa.int64()),
                        "magic": pa.array([start[:16]], pa.binary()),
                        "encoding": [encoding],
                        "bom": [bom],
                        "newlines": pa.array([start[:count].count(b"\n")], pa.int64()),
                        "head": [text],
                        "open": pa.array([left_open], pa.list_(pa.string())),
                    }
                )

    return spread(files).mapInArrow(heads, HEAD_SCHEMA)


# ---------------------------------------------------------------- CSV options


def _width(line: Column, delim: Column, quote: str = '"') -> Column:
    """Cells of a line, delimiters inside quotes left out."""
    q = re.escape(quote) if quote else r"(?!)"
    bare = F.regexp_replace(line, rf"{q}[^{q}]*(?:{q}|\z)" if quote else q, "")
    return F.char_length(bare) - F.char_length(F.replace(bare, delim, F.lit(""))) + 1


def open_quote(delim: str, quote: str = '"') -> str:
    """A pattern for lines that leave a quoted cell open."""
    d, q = re.escape(delim), re.escape(quote)
    cell = f"(?:{q}(?:[^{q}]|{q}{q})*+{q}|[^{d}{q}][^{d}]*+)?+"
    return rf"\A(?:{cell}{d})*+{q}(?:[^{q}]|{q}{q})*+\z"


def _cells(line: Column, delim: Column) -> Column:
    """Cells of a line without their quotes."""
    d = F.concat(F.lit("\\"), delim)
    pattern = F.concat(
        F.lit('((?:"[^"]*+(?:"|\\z)|[^"'), d, F.lit("]++)*+)(?:"), d, F.lit("|\\z)")
    )
    cells = F.regexp_extract_all(line, pattern, F.lit(1))
    return F.transform(cells, lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))


def _delimiter(lines: Column) -> Column:
    """The candidate with the best consistency x width over the first lines."""
    sample = F.slice(F.filter(lines, lambda s: s != ""), 1, DELIMITER_LINES)

    def score(d: str) -> Column:
        widths = F.array_sort(F.transform(sample, lambda s: _width(s, F.lit(d))))
        mid = F.coalesce(F.get(widths, F.floor(F.size(widths) / 2).cast("int")), F.lit(1))
        same = F.size(F.filter(widths, lambda w: w == mid))
        return F.when(mid > 1, same / F.greatest(F.size(widths), F.lit(1)) * mid).otherwise(-1.0)

    scores = F.array(
        *[
            F.struct(score(d).alias("score"), F.lit(-i).alias("rank"), F.lit(d).alias("delim"))
            for i, d in enumerate(DELIMITERS)
        ]
    )
    best = F.array_max(scores)
    return F.when(best["score"] >= 0, best["delim"]).otherwise(",")


def _skip(widths: Column) -> Column:
    """Lines before the first one with the most frequent width above 1."""
    wide = F.filter(widths, lambda w: w > 1)
    votes = F.transform(
        F.array_distinct(wide),
        lambda n: F.struct(F.size(F.filter(wide, lambda w: w == n)).alias("f"), (-n).alias("n")),
    )
    modal = -F.array_max(votes)["n"]
    return F.coalesce(F.array_position(widths, modal) - 1, F.lit(0)).cast("int")


# Date notations that a CSV column may use, day first.
DATE_FORMATS = (
    ("%d.%m.%Y", r"\A(\d{1,2})\.(\d{1,2})\.(\d{4})\z"),
    ("%d.%m.%y", r"\A(\d{1,2})\.(\d{1,2})\.(\d{2})\z"),
    ("%d/%m/%Y", r"\A(\d{1,2})/(\d{1,2})/(\d{4})\z"),
    ("%d/%m/%y", r"\A(\d{1,2})/(\d{1,2})/(\d{2})\z"),
)


def _date_format(cells: Column, delim: Column) -> Column:
    """Notation with most hits (at least 3) that a day above 12 or a semicolon makes certain."""

    def judged(rank: int, fmt: str, pattern: str) -> Column:
        def part(c: Column, i: int) -> Column:
            return F.regexp_extract(c, pattern, i).cast("int")

        hits = F.filter(
            F.filter(cells, lambda c: c.rlike(pattern)),
            lambda c: part(c, 1).between(1, 31) & part(c, 2).between(1, 31),
        )
        sure = F.exists(hits, lambda c: (part(c, 1) > 12) & (part(c, 2) <= 12))
        return F.struct(
            F.size(hits).alias("n"), sure.alias("sure"), F.lit(-rank).alias("rank"),
            F.lit(fmt).alias("fmt"),
        )

    best = F.array_max(F.array(*[judged(i, f, p) for i, (f, p) in enumerate(DATE_FORMATS)]))
    certain = (best["n"] >= 3) & (best["sure"] | (delim == ";"))
    return F.when(certain, best["fmt"]).otherwise(F.lit(""))


def csv_options(heads: DataFrame) -> DataFrame:
    """Detected options per file head (columns of `read_heads` are kept)."""
    step = heads.withColumn("_lines", F.split("head", r"\r?\n"))
    step = step.withColumn("delim", _delimiter(F.col("_lines")))
    step = step.withColumn(
        "_widths",
        F.transform(
            F.slice("_lines", 1, SKIP_LINES),
            lambda s: F.when(s == "", 0).otherwise(_width(s, F.col("delim"))),
        ),
    )
    step = step.withColumn("skip", _skip(F.col("_widths")))
    after = F.col("skip") + 1
    top = F.filter(F.slice("_lines", after, HEADER_LINES), lambda s: s != "")
    step = step.withColumn("_top", top)
    number = r"\A\s*-?\d+([.,]\d+)?\s*\z"
    first_has_number = F.exists(
        _cells(F.get("_top", F.lit(0)), F.col("delim")), lambda c: c.rlike(number)
    )
    step = step.withColumn("header", F.when(F.size("_top") < 2, True).otherwise(~first_has_number))
    body = F.slice(
        "_lines",
        after + F.col("header").cast("int"),
        F.lit(DATE_LINES) - F.col("header").cast("int"),
    )
    cells = F.flatten(
        F.transform(F.filter(body, lambda s: s != ""), lambda s: _cells(s, F.col("delim")))
    )
    step = step.withColumn("_cells", cells)
    ending = F.when(F.contains("head", F.lit("\r\n")), "CRLF")
    ending = ending.when(
        F.contains("head", F.lit("\r")) & ~F.contains("head", F.lit("\n")), "CR"
    ).otherwise("LF")
    return step.select(
        *[c for c in heads.columns if c != "open"],
        ending.alias("line_ending"),
        "delim",
        F.lit('"').alias("quote"),
        "skip",
        "header",
        F.lit(".").alias("decimal"),
        F.array(F.lit(""), F.lit("NULL")).alias("nulls"),
        _date_format(F.col("_cells"), F.col("delim")).alias("date_format"),
        F.array_contains("open", F.col("delim")).alias("multiline"),
    )


def detect_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row of parse options per CSV file."""
    return csv_options(read_heads(list_files(spark, paths))).drop("magic", "head", "newlines")


# ---------------------------------------------------------------- inventory


def _format(head: Column, magic: Column, path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    known = F.lit(None).cast("string")
    for ending, name in EXTENSIONS.items():
        known = F.when(ext == ending, name).otherwise(known)
    start = F.regexp_replace(F.substring(head, 1, 4096), r"\A\s+", "")
    first = F.slice(F.filter(F.split(start, r"\r?\n"), lambda s: F.trim(s) != ""), 1, 3)
    lines = (F.size(first) > 1) & F.forall(first, lambda s: F.trim(s).startswith("{"))
    json = F.when(start.startswith("{") & lines, "ndjson").otherwise("json")
    bytes_ = F.hex(magic)
    by_magic = (
        F.when(bytes_.startswith("50415231"), "parquet")
        .when(bytes_.startswith("504B"), "xlsx")
        .when(bytes_.startswith("53514C697465"), "sqlite")
        .when(F.substring(bytes_, 17, 8) == "4455434B", "duckdb")
        .when(ext == "db", "duckdb")
        .otherwise("csv")
    )
    return F.coalesce(known, F.when(ext == "json", json), by_magic)


def count_lines(files: DataFrame, size: int) -> DataFrame:
    """(path, lines, plain_lines, closed) of (path, bytes): line ends outside quotes and all of them, counted
    over byte ranges, and whether the quotes of the file close.  A last line without an end counts.

    A range says how many line ends it has behind an even and an odd number of its quotes; the quotes before
    it, one number per range, say which of them count.
    """
    from tablewright.sources.ranges import file_ranges

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as f:
                    f.seek(row["start"])
                    data = f.read(row["stop"] - row["start"])
                ends = data.count(b"\n")
                quotes = data.count(b'"')
                inside = sum(part.count(b"\n") for part in data.split(b'"')[1::2]) if quotes else 0
                yield pa.RecordBatch.from_pydict({
                    "path": [row["path"]],
                    "number": pa.array([row["number"]], pa.int64()),
                    "ends": pa.array([ends], pa.int64()),
                    "inside": pa.array([inside], pa.int64()),
                    "quotes": pa.array([quotes], pa.int64()),
                    "ended": [data.endswith(b"\n")],
                })

    schema = "path string, number bigint, ends bigint, inside bigint, quotes bigint, ended boolean"
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    found = file_ranges(files, size).mapInArrow(counts, schema)
    found = found.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    rest = (~F.max_by("ended", "number")).cast("int")
    return found.groupBy("path").agg(
        (F.sum(F.when(F.col("odd"), F.col("inside")).otherwise(F.col("ends") - F.col("inside"))) + rest).alias("lines"),
        (F.sum("ends") + rest).alias("plain_lines"),
        (F.sum("quotes") % 2 == 0).alias("closed"),
    )


def inventory_files(
    spark: SparkSession, paths: str | list[str], count: bool = False, range_bytes: int = 16 << 20
) -> DataFrame:
    """(path, bytes, format, est_rows, exact): format and estimated rows of every file.

    Rows are estimated for text tables: size over mean bytes per line of the
    head, less skipped lines and header; exact when the head was the file.
    With `count`, the lines of files that are longer than their head are counted in byte ranges.
    """
    found = csv_options(read_heads(list_files(spark, paths)))
    fmt = _format(F.col("head"), F.col("magic"), F.col("path"))
    read = F.least(F.col("bytes"), F.lit(HEAD_BYTES))
    lines = F.round(F.col("bytes") / (read / F.col("newlines")))
    less = F.when(F.col("format") == "csv", F.col("skip") + F.col("header").cast("int")).otherwise(0)
    text = F.col("format").isin("csv", "ndjson") & (F.col("newlines") > 0)
    exact = F.col("bytes") == read
    found = found.withColumn("format", fmt)
    if count:
        long = list_files(spark, paths).where(F.col("bytes") > HEAD_BYTES)
        found = found.join(count_lines(long, range_bytes), "path", "left")
        counted = F.when(F.col("format") == "csv", F.col("lines")).otherwise(F.col("plain_lines"))
        sure = (F.col("format") != "csv") | F.col("closed")
        lines, exact = F.coalesce(counted, lines), exact | (counted.isNotNull() & sure)
    return found.select(
        "path",
        "bytes",
        "format",
        F.when(text, F.greatest(F.lit(0), lines - less)).cast("bigint").alias("est_rows"),
        F.when(text, exact).alias("exact"),
    )
