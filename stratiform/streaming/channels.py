"""Publish and subscribe through folders of shared storage, for batches and streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENT = "event_id long, event_type string, source string, ts timestamp, data string"


def publish(events: DataFrame, root: str, *channels: str) -> None:
    """Append events to channels; each has a folder, which is its history."""
    for channel in channels:
        events.write.mode("append").parquet(f"{root}/channel={channel}")


def publish_stream(events: DataFrame, root: str, checkpoint: str, channels: Iterable[str]):
    """Publish a stream: every micro-batch goes to each channel once, also when it is run again."""
    names = list(channels)

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        for channel in names:
            rows.write.mode("overwrite").parquet(f"{root}/channel={channel}/batch={number}")
        rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(spark: SparkSession, root: str, channel: str, schema: str = EVENT, where: Column | None = None) -> DataFrame:
    """The channel as a stream from its beginning, with a filter; progress is in the query's checkpoint."""
    out = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/channel={channel}")
    return out if where is None else out.where(where)


def history(spark: SparkSession, root: str, channel: str, count: int | None = None, after: Column | None = None, schema: str = EVENT) -> DataFrame:
    """Published events: the last `count`, newest first, or those after a time in the order of time."""
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/channel={channel}")
    if after is not None:
        out = out.where(F.col("ts") > after).orderBy("ts", "event_id")
    return out if count is None else out.orderBy(F.desc("ts"), F.desc("event_id")).limit(count)


def change_events(changes: DataFrame, database: str, table: str) -> DataFrame:
    """Row changes (event_id, ts, change_type, ...) as events of a channel: the type is the kind of
    change, the source `database.table`, the data the row as JSON."""
    rest = [c for c in changes.columns if c not in ("event_id", "ts", "change_type")]
    return changes.select("event_id", F.lower("change_type").alias("event_type"), F.lit(f"{database}.{table}").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.to_json(F.struct(*rest)).alias("data"))


def retained(events: DataFrame, capacity: int, *order: Column) -> DataFrame:
    """What a bounded buffer holds after all events: the newest ones."""
    return events.orderBy(*[c.desc() for c in order]).limit(capacity)
