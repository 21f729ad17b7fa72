"""Merges of replicated states as aggregations, vector clocks, and key partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship_package


def gcounter(states: DataFrame) -> DataFrame:
    """(id, node, n) of all replicas: greatest per node, summed per id."""
    return states.groupBy("id", "node").agg(F.max("n").alias("n")).groupBy("id").agg(F.sum("n").alias("value"))


def pncounter(states: DataFrame) -> DataFrame:
    """(id, node, p, n): increments and decrements are counters of their own."""
    best = states.groupBy("id", "node").agg(F.max("p").alias("p"), F.max("n").alias("n"))
    return best.groupBy("id").agg((F.sum("p") - F.sum("n")).alias("value"))


def two_phase_set(added: DataFrame, removed: DataFrame) -> DataFrame:
    return added.distinct().join(removed.distinct(), added.columns, "left_anti")


def last_writer(states: DataFrame, key: str, value: str, ts: str, node: str) -> DataFrame:
    return states.groupBy(key).agg(F.max_by(value, F.struct(ts, node)).alias(value))


def or_set(states: DataFrame) -> DataFrame:
    """Elements (id, e) of observed-remove sets after a merge of replicas' states (id, replica,
    e, tag, removed): tags are united, and an element is live while any replica holds a tag of
    it. A replica's remove drops the tags that it has seen; tags that another replica still holds come back."""
    dropped = states.where("removed").select("id", "replica", "e", "tag").distinct()
    held = states.where("NOT removed").join(dropped, ["id", "replica", "e", "tag"], "left_anti")
    return held.groupBy("id", "e").agg(F.countDistinct("tag").alias("tags"))


def multi_value(states: DataFrame, clock: str = "clock") -> DataFrame:
    """Versions (id, value, clock as map node -> counter) that no other version of their id dominates.

    An id's versions are sorted so that one comes after all that dominate it: by falling number of
    nodes, then by falling counters. So a version meets only the undominated ones before it, which a
    worker holds for one id at a time.
    """
    ship_package(states.sparkSession)
    # counters are negated, as windows sort upwards
    nodes = F.sort_array(F.transform(F.map_entries(F.map_filter(clock, lambda k, v: v > 0)), lambda e: F.struct(e["key"].alias("key"), (-e["value"]).alias("n"))))
    rows = states.select("id", "value", clock).repartition("id").withColumn("_c", nodes).withColumn("_n", -F.size("_c"))
    copy = F.row_number().over(Window.partitionBy("id", "_n", "_c", "value").orderBy("id"))
    one = rows.withColumn("_copy", copy).where("_copy = 1")
    at = F.row_number().over(Window.partitionBy("id").orderBy("_n", "_c"))
    ordered = one.withColumn("_at", at).select("id", "value", clock, "_c", "_at")
    return ordered.mapInArrow(_undominated, states.select("id", "value", clock).schema)


#: Versions of an id that are compared at once.
BLOCK = 512


def _undominated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by id, in it as multi_value does, with _at = 1 where an id begins."""
    columns: dict = {}
    best: list[np.ndarray] = []
    for batch in batches:
        n = batch.num_rows
        clocks = batch.column("_c")
        known = (clocks.is_valid().to_numpy(zero_copy_only=False)) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(batch.column("_at").to_numpy() == 1)
        ends = np.append(begins[begins > 0], n)
        offsets = np.concatenate([[0], np.cumsum(clocks.value_lengths().fill_null(0).to_numpy())])
        keys, counters = clocks.flatten().flatten()
        keys = keys.dictionary_encode()
        names, codes = keys.dictionary.to_pylist(), keys.indices.to_numpy()
        counters = counters.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), np.diff(offsets))
        first, keep, low = set(begins.tolist()), np.ones(n, bool), 0
        for high in ends.tolist():
            if low in first:
                columns, best = {}, []
            for a in range(low, high, BLOCK):
                b = min(a + BLOCK, high)
                x, y = offsets[a], offsets[b]
                used, place = np.unique(codes[x:y], return_inverse=True)
                to = np.array([columns.setdefault(names[c], len(columns)) for c in used.tolist()], np.int64)
                block = np.zeros((b - a, len(columns)), counters.dtype)
                block[row[x:y] - a, to[place]] = counters[x:y]
                good = known[a:b].copy()
                own = block[good]
                # a null clock or id neither dominates nor is dominated
                beaten = _beaten(own, own)
                for i, earlier in enumerate(best):
                    if earlier.shape[1] < block.shape[1]:
                        earlier = best[i] = np.pad(earlier, ((0, 0), (0, block.shape[1] - earlier.shape[1])))
                    left = np.flatnonzero(~beaten)
                    beaten[left] = _beaten(own[left], earlier)
                keep[a + np.flatnonzero(good)[beaten]] = False
                if b == high < n:
                    break  # the id ends here
                new = own[~beaten]
                if len(new):
                    best.append(new[np.append(True, (new[1:] != new[:-1]).any(axis=1))])
                    if len(best) > 1 and len(best[-2]) + len(best[-1]) <= BLOCK:
                        best[-2:] = [np.concatenate(best[-2:])]
            low = high
        yield batch.filter(pa.array(keep)).select(batch.schema.names[:-2])


def _beaten(block: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of block's clocks one of others dominates; counters are negated."""
    up_to = np.ones((len(others), len(block)), bool)
    less = np.zeros_like(up_to)
    for a, b in zip(others.T, block.T, strict=True):
        up_to &= a[:, None] <= b
        less |= a[:, None] < b
    return (up_to & less).any(axis=0)


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_compare(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y")))
    less = F.exists(F.map_values(both), lambda e: e["x"] < e["y"])
    more = F.exists(F.map_values(both), lambda e: e["x"] > e["y"])
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[int(n * q)] of a sorted array, at most the last."""
    n = F.size(values)
    return F.element_at(values, F.least((n * q).cast("int"), n - 1) + 1)
