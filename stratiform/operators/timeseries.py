"""Time-series operators over long tables (series columns, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType, NumericType

#: Aggregates of a group of points; order by time decides first, last, rate and increase.
AGGREGATES = {
    "sum": lambda v, t: F.sum(v),
    "count": lambda v, t: F.count(v),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "avg": lambda v, t: F.avg(v),
    "first": lambda v, t: F.min_by(v, t),
    "last": lambda v, t: F.max_by(v, t),
    "median": lambda v, t: F.percentile(v, 0.5),
    "p90": lambda v, t: F.percentile(v, 0.9),
    "p99": lambda v, t: F.percentile(v, 0.99),
    "stddev": lambda v, t: F.stddev_pop(v),
    "variance": lambda v, t: F.var_pop(v),
    "rate": lambda v, t: (F.max_by(v, t) - F.min_by(v, t)) / F.nullif(F.count(v) - 1, F.lit(0)),
    "increase": lambda v, t: F.when(F.count(v) >= 2, F.max_by(v, t) - F.min_by(v, t)),
}


def time_range(points: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Half-open [start, end)."""
    return points.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def limit_per_series(points: DataFrame, series: list[str], n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*series).orderBy(*order))
    return points.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def downsample(points: DataFrame, series: list[str], interval: str, how: str, value: str = "value", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """One point per non-empty bucket, stamped with the bucket's start; buckets count from the epoch."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    bucket = F.window(ts, interval)["start"].alias("bucket")
    return points.groupBy(*series, bucket).agg(AGGREGATES[how](F.col(value), order).alias("value"))


#: Rows of a rolling window that is not merged are dealt by stretches of time this many times the window's length.
STRETCH = 24

#: Aggregates of two adjoining spans of time from those of each: the parts to take of each, then the whole from their names.
MERGED = {
    "sum": (["sum"], lambda a, b: _added(a("sum"), b("sum"))),
    "count": (["count"], lambda a, b: a("count") + b("count")),
    "min": (["min"], lambda a, b: F.least(a("min"), b("min"))),
    "max": (["max"], lambda a, b: F.greatest(a("max"), b("max"))),
    "avg": (["sum", "count"], lambda a, b: _added(a("sum"), b("sum")) / F.nullif(a("count") + b("count"), F.lit(0))),
}


def _added(a: Column, b: Column) -> Column:
    """The sum of those that are not null."""
    return F.coalesce(a + b, a, b)


def rolling(points: DataFrame, series: list[str], interval: str, how: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """Aggregate of the points of the last interval, both ends included.

    Time is cut into pieces as long as the interval, so that a window is the end of one piece and
    the beginning of the next. Both are running aggregates: each point is added twice however many
    its window holds, and a long series is many tasks. Only those in MERGED; others go through
    each window's points.
    """
    length = int(interval.split()[0]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[interval.split()[1].rstrip("s")] * 1_000_000
    own = "_" + "_".join(points.columns)
    us, part, mine = own + "us", own + "part", own + "mine"
    given, result = points.select(F.col(value).alias("v"), AGGREGATES[how](F.col(value), F.col(ts)).over(Window.partitionBy(*series)).alias("r")).schema
    exact = isinstance(given.dataType, DecimalType)
    merged = how in MERGED and (how in ("count", "min", "max") or isinstance(given.dataType, NumericType) and not (exact and how == "avg"))
    piece = length * (1 if merged else STRETCH)
    rows = points.withColumn(us, F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(part, F.floor(F.col(us) / piece))
    late = F.col(us) >= (F.col(part) + 1) * piece - length
    copies = F.when(late, F.array(F.col(part), F.col(part) + 1)).otherwise(F.array(F.col(part)))
    rows = rows.select(*points.columns, us, F.posexplode(copies).alias(mine, part))
    over = Window.partitionBy(*series, part)
    if not merged:
        out = rows.withColumn("rolled", AGGREGATES[how](F.col(value), F.col(ts)).over(over.orderBy(us).rangeBetween(-length, 0)))
        return out.where(F.col(mine) == 0).drop(us, part, mine)
    # a point of the piece before stands at its time, one of the own piece where its window begins
    before, begin = F.col(mine) == 1, own + "begin"
    rows = rows.withColumn(begin, F.when(before, F.col(us)).otherwise(F.col(us) - length))
    end = over.orderBy(F.desc(begin)).rangeBetween(Window.unboundedPreceding, 0)
    beginning = over.orderBy(us).rangeBetween(Window.unboundedPreceding, 0)
    parts, whole = MERGED[how]
    v = F.col(value).cast("double") if how == "avg" else F.col(value)
    for p in parts:
        rows = rows.withColumn(f"{own}a{p}", AGGREGATES[p](F.when(before, v), None).over(end))
        rows = rows.withColumn(f"{own}b{p}", AGGREGATES[p](F.when(~before, v), None).over(beginning))
    rolled = whole(lambda p: F.col(f"{own}a{p}"), lambda p: F.col(f"{own}b{p}")).cast(result.dataType)
    return rows.where(F.col(mine) == 0).select(*points.columns, rolled.alias("rolled"))


def instant(points: DataFrame, series: list[str], how: str, value: str = "value", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """One value per series over all its points, stamped with the last time."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return points.groupBy(*series).agg(AGGREGATES[how](F.col(value), order).alias("value"), F.max(ts).alias("ts"))


def match_tags(tags: str, equal: dict[str, str] | None = None, different: dict[str, str] | None = None, like: dict[str, str] | None = None, unlike: dict[str, str] | None = None) -> Column:
    """Label matchers over a map column: a missing key fails = and =~ and passes != and !~."""
    out = F.lit(True)
    at = lambda k: F.col(tags)[k]
    for k, v in (equal or {}).items():
        out &= F.coalesce(at(k) == v, F.lit(False))
    for k, v in (different or {}).items():
        out &= F.coalesce(at(k) != v, F.lit(True))
    for k, v in (like or {}).items():
        out &= F.coalesce(at(k).rlike(v), F.lit(False))
    for k, v in (unlike or {}).items():
        out &= F.coalesce(~at(k).rlike(v), F.lit(True))
    return out


def series_key(tags: str) -> Column:
    """k=v pairs in key order, joined by commas."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


PARTITION_FORMATS = {"minute": "yyyyMMddHHmm", "hour": "yyyyMMddHH", "day": "yyyyMMdd", "month": "yyyyMM"}


def partition_key(ts: str, unit: str) -> Column:
    """Partition label of a time; weeks are ISO weeks."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), F.col(ts)), F.lit("W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, PARTITION_FORMATS[unit])


def retention_tier(age_hours: Column, tiers: list[tuple[str, int]]) -> Column:
    """Name of the first tier whose hours the age is within; null when expired."""
    out = F.lit(None).cast("string")
    for name, hours in reversed(tiers):
        out = F.when(age_hours <= hours, name).otherwise(out)
    return out
