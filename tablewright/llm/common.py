"""Helpers the corpus operators share: tables, shared scratch tables, fingerprints of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; the warehouse, which is shared too, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def settled(df: DataFrame, kind: str = "settled") -> DataFrame:
    """Rows written as Parquet to the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks it ran, not what led up to them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; NULL ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def text_of(name: str = "text") -> Column:
    """A text column without NULL."""
    return F.coalesce(F.col(name), F.lit(""))
