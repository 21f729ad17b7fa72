"""Intermediate tables and files in the shared storage of `sources.storage`."""

from __future__ import annotations

import gc
import os
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.storage import fresh_dir, remove, scratch_dir, shared_root  # noqa: F401  for this subpackage's modules


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back: lineage ends at durable files."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Bytes of rows that may be broadcast; Spark holds a few times as much of them.
MAX_BROADCAST = 16 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The table, marked for broadcast if its rows of so many bytes are few enough. It is
    counted, so it should be a stored one."""
    return F.broadcast(df) if df.count() * row_bytes <= MAX_BROADCAST else df


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again, and let Spark drop the
    shuffle files of DataFrames that are gone (it does so when their driver objects are collected)."""
    for table in tables:
        remove(spark, table.stored_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_atomic(uri: str, parts: list[bytes]) -> None:
    """Write under a name of this attempt's own, then move into place: a retried or
    speculative task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(mine, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(mine, path)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()
