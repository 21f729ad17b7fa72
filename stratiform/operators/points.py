"""A store of time-series points in shared storage, by metric and day, and its registry of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import storage

SCHEMA = "metric string, tags map<string,string>, ts timestamp_ntz, value double, day string"
RANGES = {"1h": 3600, "6h": 6 * 3600, "24h": 86400, "7d": 7 * 86400, "30d": 30 * 86400}


def register(spark: SparkSession, root: str, metric: str, kind: str = "gauge", unit: str = "") -> None:
    """Make a metric known; it is an error if it is."""
    if any(r.metric == metric for r in metrics(spark, root).collect()):
        raise ValueError(f"metric {metric} exists")
    spark.createDataFrame([(metric, kind, unit)], "metric string, kind string, unit string").write.mode("append").json(f"{root}/metrics")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    schema = "metric string, kind string, unit string"
    return spark.read.schema(schema).json(f"{root}/metrics") if storage.names(spark, f"{root}/metrics") else spark.createDataFrame([], schema)


def write(points: DataFrame, root: str) -> None:
    """Append points (metric, tags, ts, value), partitioned by metric and day; metrics that are not registered become gauges."""
    spark = points.sparkSession
    rows = points.withColumn("day", F.date_format("ts", "yyyyMMdd"))
    rows.repartition("metric", "day").write.partitionBy("metric", "day").mode("append").parquet(f"{root}/points")
    new = read(spark, root).select("metric").distinct().join(metrics(spark, root), "metric", "left_anti")
    if not new.isEmpty():
        new.select("metric", F.lit("gauge").alias("kind"), F.lit("").alias("unit")).write.mode("append").json(f"{root}/metrics")


def read(spark: SparkSession, root: str, metric: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Points of a half-open time range; metric and days prune folders."""
    out = spark.read.schema(SCHEMA).parquet(f"{root}/points")
    if metric is not None:
        out = out.where(F.col("metric") == metric)
    if start is not None:
        out = out.where((F.col("ts") >= start) & (F.col("day") >= F.date_format(start, "yyyyMMdd")))
    if end is not None:
        out = out.where((F.col("ts") < end) & (F.col("day") <= F.date_format(end, "yyyyMMdd")))
    return out.drop("day")


def history(points: DataFrame, span: str, now: Column) -> DataFrame:
    """Points of the last 1h, 6h, 24h, 7d or 30d, to the microsecond; any other span is an hour."""
    return points.where(F.col("ts") >= now.cast(points.schema["ts"].dataType) - F.expr(f"INTERVAL {RANGES.get(span, 3600)} SECONDS"))


def drop_series(points: DataFrame, metric: str, tags: dict[str, str] | None = None) -> DataFrame:
    """The points without those of a metric, or of its series with these tags."""
    gone = F.col("metric") == metric
    for k, v in (tags or {}).items():
        gone &= F.coalesce(F.col("tags")[k] == v, F.lit(False))
    return points.where(~gone)
