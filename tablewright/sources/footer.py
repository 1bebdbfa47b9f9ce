"""Parquet footers: row groups, column chunks and what they add up to.

Executors open the files and read footers only; no data page is touched.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.columns import categories
from tablewright.sources.files import list_files, open_file, spread

register_pickle_by_value(sys.modules[__name__])  # workers need no install

CHUNK_SCHEMA = (
    "path string, row_group bigint, row_group_rows bigint, path_in_schema string, "
    "physical_type string, codec string, null_count bigint, min_value string, max_value string, "
    "compressed bigint, uncompressed bigint"
)
FILE_SCHEMA = (
    "path string, bytes bigint, rows bigint, row_groups bigint, created_by string, "
    "format_version string, columns string"
)
CHUNK_ROWS = 4096


def _parquet_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = list_files(spark, paths)
    return spread(files.where(F.lower("path").rlike(r"\.(parquet|pq)\z")))


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def _chunks(path: str) -> Iterator[dict]:
    import pyarrow.parquet as pq

    with open_file(path) as f:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                chunk = group.column(c)
                stats = chunk.statistics if chunk.is_stats_set else None
                ranged = stats is not None and stats.has_min_max
                yield {
                    "path": path,
                    "row_group": g,
                    "row_group_rows": group.num_rows,
                    "path_in_schema": chunk.path_in_schema,
                    "physical_type": chunk.physical_type,
                    "codec": chunk.compression,
                    "null_count": stats.null_count if stats and stats.has_null_count else None,
                    "min_value": _text(stats.min) if ranged else None,
                    "max_value": _text(stats.max) if ranged else None,
                    "compressed": chunk.total_compressed_size,
                    "uncompressed": chunk.total_uncompressed_size,
                }


def _file(row: dict) -> dict:
    import pyarrow.parquet as pq

    with open_file(row["path"]) as f:
        opened = pq.ParquetFile(f)
        meta = opened.metadata
        return {
            "path": row["path"],
            "bytes": row["bytes"],
            "rows": meta.num_rows,
            "row_groups": meta.num_row_groups,
            "created_by": meta.created_by,
            "format_version": meta.format_version,
            "columns": ", ".join(f"{c.name}:{c.type}" for c in opened.schema_arrow),
        }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [part.split() for part in ddl.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def parquet_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file, row group and column chunk."""
    schema = _arrow_schema(CHUNK_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                for chunk in _chunks(path):
                    rows.append(chunk)
                    if len(rows) == CHUNK_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _parquet_files(spark, paths).mapInArrow(read, CHUNK_SCHEMA)


def parquet_file_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: rows, row groups, writer, format version, columns with types."""
    schema = _arrow_schema(FILE_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_file(r) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _parquet_files(spark, paths).mapInArrow(read, FILE_SCHEMA)


def footer_profile(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per top-level column: nulls, sizes, ratio, codec, typed range, chunks.

    Numbers compare as numbers, text and times as text; other kinds show no
    range.
    """
    paths = [paths] if isinstance(paths, str) else paths
    kinds = categories(spark.read.parquet(*paths))
    chunks = parquet_metadata(spark, paths).where(F.col("path_in_schema").isin(list(kinds)))
    number = F.col("kind").isin("integer", "numeric")
    text = F.col("kind").isin("string", "temporal")
    named = spark.createDataFrame(list(kinds.items()), "column string, kind string")
    joined = chunks.join(F.broadcast(named), F.col("path_in_schema") == F.col("column"))

    def edge(f, value: str):
        as_number = f(F.when(number, F.col(value).try_cast("double")))
        as_text = f(F.when(text, F.col(value)))
        return F.coalesce(as_number.cast("string"), as_text)

    return joined.groupBy("column", "kind").agg(
        F.sum("null_count").alias("null_count"),
        F.sum("compressed").alias("compressed"),
        F.sum("uncompressed").alias("uncompressed"),
        (F.sum("compressed") / F.nullif(F.sum("uncompressed"), F.lit(0))).alias("ratio"),
        F.min("codec").alias("codec"),
        edge(F.min, "min_value").alias("min"),
        edge(F.max, "max_value").alias("max"),
        F.count(F.lit(1)).alias("chunks"),
    )


def footer_summary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row: files, rows, row groups, sizes, ratio, means per group and row, type mix."""
    paths = [paths] if isinstance(paths, str) else paths
    kinds = list(categories(spark.read.parquet(*paths)).values())
    short = {
        "integer": "int", "numeric": "num", "string": "str", "temporal": "dt", "boolean": "bool",
        "complex": "struct",
    }
    mix = ", ".join(f"{kinds.count(k)} {s}" for k, s in short.items() if k in kinds)
    sizes = parquet_metadata(spark, paths).agg(
        F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed")
    )
    files = parquet_file_metadata(spark, paths).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.sum("rows").alias("rows"),
        F.sum("row_groups").alias("row_groups"),
    )
    rows, packed, plain = F.col("rows"), F.col("compressed"), F.col("uncompressed")
    return files.crossJoin(sizes).select(  # one row each
        "files",
        "bytes",
        "rows",
        "row_groups",
        "compressed",
        "uncompressed",
        (plain / F.nullif(packed, F.lit(0))).alias("ratio"),
        F.round(rows / F.nullif("row_groups", F.lit(0))).cast("bigint").alias("rows_per_group"),
        (plain / F.nullif(rows, F.lit(0))).alias("bytes_per_row"),
        F.lit(mix).alias("type_mix"),
    )
