"""INSERT, UPDATE, DELETE and schema changes as DataFrame rewrites, and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """target and rows; columns that rows lacks get their default, else null."""
    for name, value in (defaults or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows where the predicate is TRUE get the new values, all computed from the old row."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def add_column(table: DataFrame, name: str, value: Column) -> DataFrame:
    if name in table.columns:
        raise ValueError(f"column {name} exists")
    return table.withColumn(name, value)


def drop_column(table: DataFrame, name: str, if_exists: bool = False) -> DataFrame:
    if name not in table.columns and not if_exists:
        raise ValueError(f"no column {name}")
    return table.drop(name)


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """Key values that break uniqueness, with their counts; null keys do not count."""
    known = table.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent, child[key] == parent[parent_key], "left_anti")


def check_violations(table: DataFrame, check: Column) -> DataFrame:
    return table.where(~check)
