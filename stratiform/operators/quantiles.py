"""Exact order statistics without gathering a group in one task.

A mergeable sketch gives an interval around each wanted rank, wider than its error; rows
below it are counted, and only the distinct values inside it, with their counts, are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The sketch's ranks are right to one part in this many of the group's rows.
ACCURACY = 10_000


def at_ranks(rows: DataFrame, groups: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The groups' columns, and under each name the value at that rank (a column over n, the number
    of non-null values of the group; ranks from 0, in rising order of the values)."""
    names, keys = list(ranks), [f"g{i}" for i in range(len(groups))]
    known = rows.where(F.col(value).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(value).alias("v"))
    sizes = known.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", [k / 1000 for k in range(1001)], ACCURACY).alias("s"))
    # the interval reaches one step of the sketch beyond the rank on each side
    step = lambda r, d: F.greatest(F.lit(0), F.least(F.lit(1000), (r * 1000 / F.greatest(F.col("n") - 1, F.lit(1))).cast("int") + d))
    bound = lambda r, d: F.when(step(r, d) == 0, F.col("lo")).when(step(r, d) == 1000, F.col("hi")).otherwise(F.get("s", step(r, d)))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), r.cast("long").alias("rank"), bound(r, -2).alias("a"), bound(r, 3).alias("b")) for k, r in enumerate(ranks.values())])
    wanted = sizes.select(*keys, "n", F.explode(wanted).alias("w")).select(*keys, "n", "w.*")
    kept = [F.collect_list(F.struct("k", "rank", "a", "b")).alias("w")]
    spans = wanted.groupBy(*keys).agg(*kept)
    met = known.join(spans, keys) if keys else known.crossJoin(F.broadcast(spans))
    # a value beyond the interval is counted under a null
    each = met.select(*keys, "v", F.explode("w").alias("w")).select(*keys, "w.k", "w.rank", F.when(F.col("v") < F.col("w.a"), None).when(F.col("v") <= F.col("w.b"), F.col("v")).alias("x"), (F.col("v") < F.col("w.a")).alias("below"))
    counts = each.where("below OR x IS NOT NULL").groupBy(*keys, "k", "rank", "x").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys, "k").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("c").over(order))
    hit = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")) & F.col("x").isNotNull()
    out = upto.where(hit).groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(name) for k, name in enumerate(names)])
    return out.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], *names)


def nearest_rank(rows: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """sorted[int(n * q)], at most the last."""
    n = F.col("n")
    return at_ranks(rows, groups, value, {name: F.least((n * q).cast("long"), n - 1) for name, q in quantiles.items()})


def interpolated(rows: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear interpolation between the two values around (n - 1) * q."""
    n, n_at = F.col("n"), "n" + "_".join(groups)
    ranks = {f"{name}_{side}": rank for name, q in quantiles.items() for side, rank in (("a", F.floor((n - 1) * q)), ("b", F.ceil((n - 1) * q)))}
    size = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias(n_at))
    found = at_ranks(rows, groups, value, ranks).join(size, groups)
    part = lambda q: (F.col(n_at) - 1) * q - F.floor((F.col(n_at) - 1) * q)
    return found.select(*groups, *[(F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * part(q)).alias(name) for name, q in quantiles.items()])
