"""Detectors over security events: sliding counts, with or without a reset when they fire, and rules on single events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F


def bursts(events: DataFrame, key: Column, threshold: int, seconds: int, ts: str = "ts", event: str = "event_id") -> DataFrame:
    """(key, event, ts, attempts) of the events at which a key's counter reaches the threshold
    within the window; the counter starts anew there.

    Events further apart than the window never meet, so a key's events fall into runs between such
    gaps and only one run at a time is put in order for the counter. A run of a key that never rests is one group.
    """
    from pyspark.sql import Window

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(key.alias("key"), F.col(event).alias("event"), F.col(ts).alias("ts"), micros.alias("us"))
    order = Window.partitionBy("key").orderBy("us", "event")
    gap = F.coalesce(F.col("us") - F.lag("us").over(order) > seconds * 1_000_000, F.lit(True))
    runs = rows.withColumn("run", F.sum(gap.cast("int")).over(order))
    # a run shorter than the threshold never fires
    grouped = runs.groupBy("key", "run").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("us", "event", "ts"))).alias("e")).where(F.col("n") >= threshold)
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("open"), F.filter("e", lambda x: F.lit(False)).alias("fired"))

    def step(acc: Column, x: Column) -> Column:
        now = F.concat(F.filter(acc["open"], lambda u: u >= x["us"] - seconds * 1_000_000), F.array(x["us"]))
        fires = F.size(now) >= threshold
        return F.struct(F.when(fires, none).otherwise(now).alias("open"), F.when(fires, F.concat(acc["fired"], F.array(x))).otherwise(acc["fired"]).alias("fired"))

    fired = grouped.select("key", F.explode(F.aggregate("e", start, step)["fired"]).alias("x"))
    return fired.select("key", "x.event", "x.ts", F.lit(threshold).alias("attempts"))


def bursts_stream(events: DataFrame, threshold: int, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """The same over a stream of (key string, event_id long, ts timestamp): (key, event_id, ts).

    State is a key's open times, at most threshold - 1 of them; it goes when the watermark has
    passed the window. Events of one batch are taken in the order of time.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    window = pd.Timedelta(seconds=seconds)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = [pd.Timestamp(u, unit="us") for u in state.get[0]] if state.exists else []
        fired = []
        for part in parts:
            for event, ts in part.sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
                open_ = [t for t in open_ if t >= ts - window] + [ts]
                if len(open_) >= threshold:
                    fired.append((key[0], event, ts))
                    open_ = []
        if open_:
            state.update(([int(t.value // 1000) for t in open_],))
            state.setTimeoutTimestamp(max(int(max(open_).value // 1_000_000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(fired, columns=["key", "event_id", "ts"])

    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("key").applyInPandasWithState(run, "key string, event_id long, ts timestamp", "open array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def rules(rows: Column, address: Column, trusted: list[str], most_rows: int = 1000) -> Column:
    """The rules that an event breaks: mass_operation (so many rows or more), untrusted_ip (an address not in the list; none is fine)."""
    found = F.array(F.when(rows >= most_rows, "mass_operation"), F.when(address.isNotNull() & ~address.isin(trusted), "untrusted_ip"))
    return F.filter(found, lambda x: x.isNotNull())
