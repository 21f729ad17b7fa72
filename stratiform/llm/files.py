"""Fixed-size artefacts that travel to workers with Spark's own file distribution, and what workers keep of them."""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import shutil
import uuid
from typing import Any

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .store import scratch_dir


def distribute(spark: SparkSession, path: str) -> str:
    """Offer a driver-side file to all executors, present and future; returns the name for `local_path`."""
    name = f"{uuid.uuid4().hex}-{os.path.basename(path)}"
    copy = os.path.join(scratch_dir(), name)
    shutil.copyfile(path, copy)
    spark.sparkContext.addFile(copy)
    return name


def distribute_object(spark: SparkSession, value: Any) -> str:
    """The same for a picklable object; see `load_object`."""
    name = f"{uuid.uuid4().hex}.pkl"
    path = os.path.join(scratch_dir(), name)
    with open(path, "wb") as f:
        pickle.dump(value, f)
    spark.sparkContext.addFile(path)
    return name


def local_path(name: str) -> str:
    return SparkFiles.get(name)


def load_object(name: str) -> Any:
    with open(local_path(name), "rb") as f:
        return pickle.load(f)


_held: dict = {}


def held(key: tuple, make):
    """What make() gives, made once a worker. A worker is used again by later operators, so
    only the last key's object is kept; memory of earlier ones goes back to the system."""
    if key not in _held:
        _drop()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For operators that hold nothing: what an earlier one left in the worker goes back to the system."""
    if _held:
        _drop()


def _drop() -> None:
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file; the default for the operators' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)
