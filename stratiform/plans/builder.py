"""A fluent query builder that produces a DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

OPERATORS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "like": lambda a, b: a.like(b)}


class Query:
    def __init__(self, source: DataFrame):
        self.source = source
        self.conditions: list[Column] = []
        self.groups: list[str] = []
        self.columns: list = []
        self.filters: list[Column] = []
        self.orders: list[Column] = []
        self.size: int | None = None
        self.skip = 0

    def select(self, *columns) -> "Query":
        self.columns += columns
        return self

    def where(self, column: str, op: str, value: Any) -> "Query":
        self.conditions.append(OPERATORS[op.lower()](F.col(column), value))
        return self

    def where_in(self, column: str, values: list) -> "Query":
        self.conditions.append(F.col(column).isin(values))
        return self

    def where_null(self, column: str) -> "Query":
        self.conditions.append(F.col(column).isNull())
        return self

    def where_not_null(self, column: str) -> "Query":
        self.conditions.append(F.col(column).isNotNull())
        return self

    def where_between(self, column: str, low: Any, high: Any) -> "Query":
        self.conditions.append(F.col(column).between(low, high))
        return self

    def where_like(self, column: str, pattern: str) -> "Query":
        return self.where(column, "like", pattern)

    def or_where(self, column: str, op: str, value: Any) -> "Query":
        """ORed with the last condition."""
        self.conditions.append(self.conditions.pop() | OPERATORS[op.lower()](F.col(column), value))
        return self

    def join(self, other: DataFrame, left: str, right: str, how: str = "inner") -> "Query":
        self.source = self.source.join(other, F.col(left) == F.col(right), how)
        return self

    def left_join(self, other: DataFrame, left: str, right: str) -> "Query":
        return self.join(other, left, right, "left")

    def right_join(self, other: DataFrame, left: str, right: str) -> "Query":
        return self.join(other, left, right, "right")

    def group_by(self, *columns: str) -> "Query":
        self.groups += columns
        return self

    def having(self, condition: Column) -> "Query":
        self.filters.append(condition)
        return self

    def order_by(self, column: str, descending: bool = False) -> "Query":
        self.orders.append(F.desc_nulls_first(column) if descending else F.asc_nulls_last(column))
        return self

    def limit(self, n: int) -> "Query":
        self.size = n
        return self

    def offset(self, n: int) -> "Query":
        self.skip = n
        return self

    def build(self) -> DataFrame:
        out = self.source
        for c in self.conditions:
            out = out.where(c)
        if self.groups:
            out = out.groupBy(*self.groups).agg(*[c for c in self.columns if not isinstance(c, str)])
            for c in self.filters:
                out = out.where(c)
        elif self.columns:
            out = out.select(*self.columns)
        if self.orders:
            out = out.orderBy(*self.orders)
        if self.skip:
            out = out.offset(self.skip)
        return out.limit(self.size) if self.size is not None else out

    def count(self) -> int:
        return self.build().count()

    def exists(self) -> bool:
        return not self.build().isEmpty()

    def first(self):
        return self.build().first()

    def pluck(self, column: str) -> list:
        return [r[0] for r in self.build().select(column).collect()]

    def to_dicts(self) -> list[dict]:
        return [r.asDict() for r in self.build().collect()]

    def to_dataframe(self):
        """The rows as a pandas DataFrame."""
        return self.build().toPandas()


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"


class Statement:
    """INSERT, UPDATE and DELETE over a Database: `insert_into("t").columns("a").values(1).run(db)`,
    `update("t").set(a=1).where("b", "=", 2).run(db)`, `delete_from("t").where("b", "=", 2).run(db)`."""

    def __init__(self, kind: str, table: str):
        self.kind, self.table = kind, table
        self.names: list[str] = []
        self.rows: list[tuple] = []
        self.changes: dict[str, Any] = {}
        self.conditions: list[str] = []

    def columns(self, *names: str) -> "Statement":
        self.names += names
        return self

    def values(self, *row: Any) -> "Statement":
        self.rows.append(row)
        return self

    def set(self, **changes: Any) -> "Statement":
        self.changes |= changes
        return self

    def where(self, column: str, op: str, value: Any) -> "Statement":
        if op.lower() not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        self.conditions.append(f"`{column}` {op} {_literal(value)}")
        return self

    def text(self) -> str:
        if self.kind == "insert":
            listed = f" ({', '.join(self.names)})" if self.names else ""
            return f"INSERT INTO {self.table}{listed} VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        where = f" WHERE {' AND '.join(self.conditions)}" if self.conditions else ""
        if self.kind == "update":
            return f"UPDATE {self.table} SET " + ", ".join(f"{c} = {_literal(v)}" for c, v in self.changes.items()) + where
        return f"DELETE FROM {self.table}{where}"

    def run(self, database) -> DataFrame:
        return database.execute(self.text())


def insert_into(table: str) -> Statement:
    return Statement("insert", table)


def update(table: str) -> Statement:
    return Statement("update", table)


def delete_from(table: str) -> Statement:
    return Statement("delete", table)
