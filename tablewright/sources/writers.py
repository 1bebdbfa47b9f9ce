"""Writers: Parquet, CSV, NDJSON, JSON arrays, Markdown, HTML, tables."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import COMPLEX_TYPES, all_of, col, text_of

register_pickle_by_value(sys.modules[__name__])  # workers need no install

SAFE_INTEGER = 2**53
CODECS = ("snappy", "zstd", "gzip", "uncompressed")


def write_parquet(
    df: DataFrame,
    path: str,
    codec: str = "snappy",
    row_group_bytes: int | None = None,
    max_rows_per_file: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Parquet; row groups are sized in bytes, files may be limited in rows."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec} is none of {', '.join(CODECS)}")
    writer = df.write.mode(mode).option("compression", codec)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)


def write_csv(
    df: DataFrame,
    path: str,
    delim: str = ",",
    header: bool = True,
    gzip: bool = False,
    mode: str = "errorifexists",
) -> None:
    """CSV with quotes doubled inside quotes; nested cells are written as JSON.

    Blanks at the ends of cells are kept.  A table of one column has its cells in quotes, as readers
    pass over lines of nothing but blanks.
    """
    flat = df.select(
        *[
            text_of(df, f.name).alias(f.name)
            if isinstance(f.dataType, COMPLEX_TYPES)
            else col(f.name)
            for f in df.schema.fields
        ]
    )
    options = {
        "sep": delim, "header": header, "escape": '"', "emptyValue": "", "quoteAll": len(df.columns) == 1,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    if gzip:
        options["compression"] = "gzip"
    flat.write.mode(mode).options(**options).csv(path)


# ---------------------------------------------------------------- JSON


def _is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.LongType) or (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0 and dtype.precision > 15
    )


def _safe(c: Column) -> Column:
    return c.between(-SAFE_INTEGER, SAFE_INTEGER)


def _all_safe(c: Column, dtype: T.DataType) -> Column | None:
    """True where no whole number inside is beyond 2^53; None when the type holds none."""
    if _is_whole(dtype):
        return F.coalesce(_safe(c), F.lit(True))
    if isinstance(dtype, T.StructType):
        parts = [_all_safe(c.getField(f.name), f.dataType) for f in dtype.fields]
        parts = [p for p in parts if p is not None]
        return all_of(parts) if parts else None
    if isinstance(dtype, T.ArrayType) and _all_safe(F.lit(None), dtype.elementType) is not None:
        each = F.forall(c, lambda x: _all_safe(x, dtype.elementType))
        return F.coalesce(each, F.lit(True))
    return None


def _json_ready(c: Column, dtype: T.DataType, exact: bool) -> Column:
    """Times in ISO form; with `exact`, whole numbers beyond 2^53 as text; inside too."""
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd'T'00:00:00.000'Z'")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if exact and _is_whole(dtype):
        text = c.cast("string")
        quoted = F.concat(F.lit('"'), text, F.lit('"'))
        return F.parse_json(F.when(_safe(c), text).otherwise(quoted))
    if isinstance(dtype, T.StructType) and dtype.fields:
        inner = [
            _json_ready(c.getField(f.name), f.dataType, exact).alias(f.name) for f in dtype.fields
        ]
        return F.when(c.isNotNull(), F.struct(*inner))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _json_ready(x, dtype.elementType, exact))
    return c


def json_lines(df: DataFrame, pretty: bool = False) -> DataFrame:
    """(value): one JSON object per row; NULLs are kept.

    Only rows that hold a number beyond 2^53 take the slower exact form.
    """
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}

    def text(exact: bool) -> Column:
        fields = [
            _json_ready(col(f.name), f.dataType, exact).alias(f.name) for f in df.schema.fields
        ]
        return F.to_json(F.struct(*fields), options)

    checks = [_all_safe(col(f.name), f.dataType) for f in df.schema.fields]
    checks = [c for c in checks if c is not None]
    value = F.when(all_of(checks), text(False)).otherwise(text(True)) if checks else text(False)
    return df.select(value.alias("value"))


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(df).write.mode(mode).text(path)


def wrapped(
    rows: DataFrame,
    first: str | list[str],
    last: str | list[str] | None = None,
    glue: str = "",
) -> DataFrame:
    """The text rows of each partition between first and last lines, `glue` after all but the last."""
    head = [first] if isinstance(first, str) else first
    tail = [last] if isinstance(last, str) else last or []

    def lines(values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield lines(head)
        held: pa.Array | None = None
        for batch in batches:
            texts = pc.drop_null(batch.column(0))
            if not len(texts):
                continue
            if not glue:
                yield pa.RecordBatch.from_arrays([texts], names=["value"])
                continue
            if held is not None:
                texts = pa.concat_arrays([held, texts])
            held = texts.slice(len(texts) - 1)
            body = pc.binary_join_element_wise(texts.slice(0, len(texts) - 1), glue, "")
            yield pa.RecordBatch.from_arrays([body], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([held], names=["value"])
        if tail:
            yield lines(tail)

    return rows.mapInArrow(wrap, "value string")


def one_partition(rows: DataFrame) -> DataFrame:
    """All rows in one task, with a NULL row so that an empty table gives a task too."""
    return rows.unionByName(rows.sparkSession.sql("SELECT CAST(NULL AS STRING) AS value")).coalesce(1)


def write_json_array(
    df: DataFrame,
    path: str,
    pretty: bool = False,
    single_file: bool = False,
    mode: str = "errorifexists",
) -> None:
    """JSON arrays: every part file is one array.

    `single_file` asks for one file, and so for one writing task.
    """
    lines = json_lines(df, pretty)
    lines = one_partition(lines) if single_file else lines
    wrapped(lines, "[", "]", ",").write.mode(mode).text(path)


# ---------------------------------------------------------------- documents


def _cell(df: DataFrame, name: str) -> Column:
    return F.coalesce(text_of(df, name), F.lit(""))


def _markdown_escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(text, r"\r?\n", "<br>")


def _html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _document(
    rows: DataFrame, before: list[str], close: list[str], note: str, end: list[str], cap: int | None
) -> DataFrame:
    """A document per partition; with `cap` one of at most so many rows, and a note if it cuts."""
    if cap is None:
        return wrapped(rows, before, close + end)
    cut = [note] if rows.limit(cap + 1).count() > cap else []
    return wrapped(one_partition(rows.limit(cap)), before, close + cut + end)


def markdown_lines(df: DataFrame, cap: int | None = None) -> DataFrame:
    """(value): the lines of a pipe table per partition; `cap` asks for one of at most so many rows."""

    def line(cells: list[str]) -> str:
        return "| " + " | ".join(cells) + " |"

    def escape(name: str) -> str:
        return name.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")

    cells = [_markdown_escape(_cell(df, c)) for c in df.columns]
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = [line([escape(c) for c in df.columns]), line(["---"] * len(df.columns))]
    return _document(rows, head, [], f"\n> Note: output truncated to {cap or 0:,} rows.", [], cap)


def write_markdown(
    df: DataFrame, path: str, cap: int | None = None, mode: str = "errorifexists"
) -> None:
    """Markdown: every part file is a table; `cap` asks for one file of at most so many rows."""
    markdown_lines(df, cap).write.mode(mode).text(path)


def html_lines(df: DataFrame, title: str = "table", cap: int | None = None) -> DataFrame:
    """(value): the lines of an HTML page per partition; `cap` asks for one of at most so many rows."""

    def escape(text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def tagged(name: str) -> Column:
        return F.concat(F.lit("<td>"), _html_escape(_cell(df, name)), F.lit("</td>"))

    cells = F.concat(F.lit("<tr>"), *[tagged(c) for c in df.columns], F.lit("</tr>"))
    head = [
        '<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8">',
        f"<title>{escape(title)}</title></head><body>\n<table>",
        "<thead><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr></thead><tbody>",
    ]
    note = f"<p>Note: output truncated to {cap or 0:,} rows.</p>"
    rows = df.select(cells.alias("value"))
    return _document(rows, head, ["</tbody></table>"], note, ["</body></html>"], cap)


def write_html(
    df: DataFrame,
    path: str,
    title: str = "table",
    cap: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """HTML: every part file is a page with a table; `cap` asks for one file of at most so many rows."""
    html_lines(df, title, cap).write.mode(mode).text(path)


# ---------------------------------------------------------------- tables


def write_table(df: DataFrame, name: str, mode: str = "replace") -> int:
    """Write to a table of the catalog and return the rows it then holds.

    create fails when the table is present.  replace writes the new rows beside the old ones, so a
    result may read the table it replaces, and then swaps them in one step of the catalog: a staged
    replacement where the catalog has that, else a new location.  Whatever fails before leaves the old
    rows.  Only a session catalog's table whose columns change needs two renames, between which its rows
    stand under another name, which the error tells.
    """
    spark = df.sparkSession
    if mode == "append":
        df.write.mode("append").saveAsTable(name)
    elif mode == "create" or not spark.catalog.tableExists(name):
        df.write.mode("errorifexists").saveAsTable(name)
    elif mode != "replace":
        raise ValueError(f"mode {mode} is none of replace, create, append")
    elif spark.catalog.getTable(name).catalog != "spark_catalog":
        df.writeTo(name).createOrReplace()
    else:
        _replace(df, name)
    return spark.table(name).count()


def _columns(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def _replace(df: DataFrame, name: str) -> None:
    spark = df.sparkSession
    details = {
        r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    }
    tag = uuid.uuid4().hex
    plain = "# Partition Information" not in details and details.get("Provider") == "parquet"
    if plain and _columns(spark.table(name).schema) == _columns(df.schema):
        old = details["Location"]
        new = f"{re.sub('-[0-9a-f]{32}$', '', old.rstrip('/'))}-{tag}"
        df.write.mode("errorifexists").parquet(new)
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{new}'")
        spark.catalog.refreshTable(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return
    beside = f"{name}_{tag}"
    old = f"{beside}_old"
    df.write.mode("errorifexists").saveAsTable(beside)
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")  # its rows stay until the new table stands
    try:
        spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
    except Exception as error:
        spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise RuntimeError(f"{name} keeps its old rows, the new ones are in {beside}") from error
    spark.sql(f"DROP TABLE {old}")
