"""Event streams: filters, tumbling windows, change data capture. The same functions serve
batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def event_filter(event_type: str | None = None, source_prefix: str | None = None, after: str | None = None) -> Column:
    out = F.lit(True)
    if event_type:
        out &= F.col("event_type") == event_type
    if source_prefix:
        out &= F.col("source").startswith(source_prefix)
    if after:
        out &= F.col("ts") > F.lit(after).cast("timestamp")
    return out


def tumbling(events: DataFrame, size: str, *aggregates: Column, keys: tuple[str, ...] = (), lateness: str = "0 seconds") -> DataFrame:
    """Windows aligned to the epoch. In a stream, rows later than the watermark are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    grouped = events.groupBy(*keys, F.window("ts", size).alias("w")).agg(*aggregates)
    return grouped.select(*keys, F.col("w.start").alias("start"), *[c for c in grouped.columns if c not in (*keys, "w")])


def capture(changes: DataFrame, types: list[str], columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    out = changes.where(F.col("change_type").isin(types))
    if where:
        out = out.where(where)
    return out.select(*columns) if columns else out


def replay(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Current rows: the last image of each key; deleted keys are gone."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("change_type", "after"), F.struct(*order)).alias("last"))
    return last.where("last.change_type <> 'Delete'").select(key, F.col("last.after").alias("after"))
