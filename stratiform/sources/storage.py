"""Shared storage that the driver and every executor can reach, and small files in it.

Everything lives under the folder that the cluster names in ``spark.checkpoint.dir``. Only
where that is unset and Spark runs on this machine alone (tests) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Without one a cluster is refused: each executor would
    write to its own disk and later reads would miss those files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{scratch_dir()}"
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


@lru_cache(maxsize=1)
def scratch_dir() -> str:
    """A folder of the driver for files that Spark hands out; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="stratiform-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI for one run of one operator."""
    return f"{shared_root(spark).rstrip('/')}/stratiform/{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, uri: str):
    """Hadoop's file system and path of a URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = hadoop(spark, uri)
    fs.delete(path, True)


def names(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, path = hadoop(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_text(spark: SparkSession, uri: str) -> str:
    fs, path = hadoop(spark, uri)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """A new small file, whole or not at all; it is an error if it is there."""
    fs, path = hadoop(spark, uri)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{uri}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(own)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(path) or not fs.rename(own, path):
        fs.delete(own, False)
        raise FileExistsError(uri)
