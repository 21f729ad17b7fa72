"""Key-value commands as a log: (key, seq, op, value, expected, ttl) rows, read as of a time.

op is put, delete, cas (value replaces `expected`, null for an absent key) or increment (text as a
number, absent or unreadable as 0, plus one). Only what follows a key's last put or delete
matters, so logs are cut there first, by aggregation; of keys without a cas the rest is a
count. Only the commands after the last put or delete of a key with a cas are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def state(log: DataFrame) -> DataFrame:
    """(key, value, n_swapped): present keys after all commands, and how many cas of those that count took effect."""
    reset = F.col("op").isin("put", "delete")
    last = log.groupBy("key").agg(
        F.max(F.when(reset, F.col("seq"))).alias("from"),
        F.max_by(F.when(F.col("op") == "put", F.col("value")), F.when(reset, F.col("seq"))).alias("base"),
        F.max_by(F.col("op") == "put", F.when(reset, F.col("seq"))).alias("there"),
        F.max(F.when(F.col("op") == "cas", F.col("seq"))).alias("cas"),
    )
    # commands that still act, counted where their order says nothing
    tail = log.where(~reset).join(last, "key").where(F.col("from").isNull() | (F.col("seq") > F.col("from")))
    ordered = F.col("cas") > F.coalesce("from", F.lit(-1).cast("long"))
    counted = tail.where(~F.coalesce(ordered, F.lit(False))).groupBy("key").agg(F.count("*").alias("n"))
    steps = tail.where(ordered).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "value", "expected"))).alias("steps"))
    start = F.struct(F.coalesce("there", F.lit(False)).alias("there"), F.col("base").alias("value"), F.lit(0).cast("long").alias("swapped"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(acc["there"], acc["value"])
        hit = (x["op"] == "cas") & now.eqNullSafe(x["expected"]) & x["value"].isNotNull()
        more = F.struct(F.lit(True).alias("there"), (_number(now) + 1).cast("string").alias("value"), acc["swapped"].alias("swapped"))
        swap = F.struct(F.lit(True).alias("there"), x["value"].alias("value"), (acc["swapped"] + 1).alias("swapped"))
        return F.when(x["op"] == "increment", more).when(hit, swap).otherwise(acc)

    out = last.join(counted, "key", "left").join(steps, "key", "left")
    plain = F.struct((F.coalesce("there", F.lit(False)) | F.col("n").isNotNull()).alias("there"), F.when(F.col("n").isNotNull(), (_number(F.when(F.col("there"), F.col("base"))) + F.col("n")).cast("string")).otherwise(F.col("base")).alias("value"), F.lit(0).cast("long").alias("swapped"))
    end = F.when(F.col("steps").isNull(), plain).otherwise(F.aggregate("steps", start, step))
    return out.select("key", end.alias("s")).where("s.there").select("key", F.col("s.value").alias("value"), F.col("s.swapped").alias("n_swapped"))


def current(entries: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(key, value, updated_at) of puts and deletes (key, op, value, ttl, updated_at, seq): the
    last entry of each key, if it is a put that has not expired at `as_of` (ttl in seconds, null for ever)."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("op", "value", "ttl", "updated_at"), F.struct("updated_at", "seq")).alias("e")).select("key", "e.*").where("op = 'put'")
    if as_of is not None:
        ends = F.timestamp_seconds(F.unix_timestamp(F.col("updated_at").cast("timestamp")) + F.col("ttl"))
        last = last.where(F.coalesce(ends > as_of.cast("timestamp"), F.lit(True)))
    return last.select("key", "value", "updated_at")


def prefix(entries: DataFrame, start: str, limit: int | None = None) -> DataFrame:
    """Entries whose key begins so, in the order of keys."""
    out = entries.where(F.col("key").startswith(start)).orderBy("key")
    return out if limit is None else out.limit(limit)
