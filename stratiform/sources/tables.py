"""Tables of a folder of Parquet files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_over(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], text: str, args: dict | list | None = None) -> DataFrame:
    """SQL over named tables; only those the text names are opened. They are views while the
    text is analysed, which is at once; views of the user under these names are as before after it."""
    before = {}
    try:
        for name, table in tables.items():
            if re.search(rf"(?i)\b{re.escape(name)}\b", text):
                opened = table()
                before[name] = spark.table(name) if any(t.name.lower() == name.lower() and t.isTemporary for t in spark.catalog.listTables()) else None
                opened.createOrReplaceTempView(name)
        return spark.sql(text, args=args or None)
    finally:
        for name, old in before.items():
            if old is None:
                spark.catalog.dropTempView(name)
            else:
                old.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, folder: str, text: str, **args) -> DataFrame:
    """SQL over the folder's tables."""
    return sql_over(spark, {name: lambda name=name: load(spark, folder, name) for name in TABLES}, text, args)
