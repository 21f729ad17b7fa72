"""Hash-chained logs: (seq, payload, prev_hash, hash) rows, hash = SHA-256 of prev_hash and payload."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GENESIS = "genesis"


def entry_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, payload), 256)


def chain(payloads: Iterable[str], prev: str = GENESIS, first: int = 0) -> Iterator[tuple[int, str, str, str]]:
    """The entries of a log, in order; a writer goes on with the last hash and the next number."""
    for i, payload in enumerate(payloads, first):
        here = hashlib.sha256((prev + payload).encode()).hexdigest()
        yield i, payload, prev, here
        prev = here


def verify(log: DataFrame, chain_key: str | None = None, genesis: str | None = None) -> DataFrame:
    """Entries that break the chain, with the fault: `hash` (not that of its content), `link` (prev_hash
    is not the hash of the entry before), `gap` (there is none before), `start` (the first
    entry's prev_hash is not `genesis`; without one any is accepted, as older files may be gone).

    Entries meet their predecessors by number, so a long log is not ordered in one task.
    """
    keys = [chain_key] if chain_key else []
    first = log.groupBy(*keys).agg(F.min("seq").alias("first"))
    before = log.select(*keys, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    out = log.join(before, [*keys, "seq"], "left")
    out = out.join(first, keys) if keys else out.crossJoin(F.broadcast(first))
    is_first = F.col("seq") == F.col("first")
    own = ~F.coalesce(F.col("hash") == entry_hash(F.col("prev_hash"), F.col("payload")), F.lit(False))
    start = is_first & (F.col("prev_hash") != genesis) if genesis is not None else F.lit(False)
    fault = F.when(own, "hash").when(start, "start").when(~is_first & F.col("before").isNull(), "gap").when(~is_first & (F.col("before") != F.col("prev_hash")), "link")
    return out.withColumn("fault", fault).where("fault IS NOT NULL").drop("first", "before")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All rotated files of a folder; lines that are no JSON have null fields."""
    columns = ["seq long", "payload string", "prev_hash string", "hash string"]
    return spark.read.schema(", ".join(columns)).json(folder).select(*[c.split()[0] for c in columns])


def write_log(log: DataFrame, folder: str, lines: int = 100_000) -> None:
    """Rotated JSON-lines files of so many entries each, by number."""
    file = F.floor(F.col("seq") / lines)
    rows = log.withColumn("file", file).repartition("file").sortWithinPartitions("seq")
    rows.write.partitionBy("file").option("maxRecordsPerFile", lines).mode("append").json(folder)
