"""Named tables for free SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Registers DataFrames under safe names; the first one is also `data`."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def alias(self, name: str) -> str:
        """Lower case, other characters than a-z 0-9 _ as _, no leading digit, no name twice."""
        base = re.sub(r"\.parquet$", "", name, flags=re.IGNORECASE).lower()
        base = re.sub(r"[^a-z0-9_]+", "_", base).strip("_") or "file"
        if base[0].isdigit():
            base = "t_" + base
        taken, alias, n = {"data", *self.tables}, base, 2
        while alias in taken:
            alias, n = f"{base}_{n}", n + 1
        return alias

    def register(self, name: str, df: DataFrame) -> str:
        alias = self.alias(name)
        self.tables[alias] = df
        df.createOrReplaceTempView(alias)
        if len(self.tables) == 1:
            self.activate(alias)
        return alias

    def activate(self, alias: str) -> None:
        """Point `data` at a registered table."""
        self.tables[alias].createOrReplaceTempView("data")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)
