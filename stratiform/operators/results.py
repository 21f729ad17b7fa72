"""Results as text: JSON lines, CSV lines, a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def csv_lines(df: DataFrame) -> DataFrame:
    """One line a row, values quoted where they need it; the header is `csv_header`."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in df.columns)


def text_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows, drawn."""
    shown = [[("NULL" if v is None else str(v)) for v in row] for row in df.limit(rows).collect()]
    width = [max(len(c), *(len(r[i]) for r in shown), 1) for i, c in enumerate(df.columns)] if shown else [len(c) for c in df.columns]
    bar = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, width, strict=True)) + "|"
    return "\n".join([bar, line(df.columns), bar, *map(line, shown), bar])


def union_of_stores(stores: dict[str, DataFrame], fixed: list[str]) -> DataFrame:
    """Rows of several stores under one another: store, the fixed columns, then all others in order of name."""
    out = None
    for name, df in stores.items():
        part = df.withColumn("store", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rest = sorted(set(out.columns) - {"store", *fixed})
    return out.select("store", *fixed, *rest)
