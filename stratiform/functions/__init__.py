"""Scalar functions that Spark has under other names or not at all."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, functions as F


def hash64(data: Column) -> Column:
    """A 64-bit hash of a text or bytes (xxHash64)."""
    return F.xxhash64(data)


def hash128(data: Column) -> Column:
    """A 128-bit hash in hexadecimal (MD5)."""
    return F.md5(data.cast("binary"))


def ring_hash(key: Column, places: int = 1 << 32) -> Column:
    """A key's place on a ring: the first 32 bits of its MD5, modulo the places."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(places))


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def json_contains(doc: Column, field: str, value: Any) -> Column:
    """True where a field of that name has that value at any depth of a JSON text.

    An unescaped quote before a colon can only end a field's name, as quotes in strings are escaped.
    """
    import json

    text = re.escape(json.dumps(value, ensure_ascii=False))
    name = re.escape(json.dumps(field, ensure_ascii=False))
    return F.coalesce(doc.rlike(rf"(?<!\\){name}\s*:\s*{text}\s*[,}}\]]"), F.lit(False))


#: Partitioning of keys by strategy, as numbers from 0.


def by_hash(n: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def by_range(column: Column, upper_bounds: list) -> Column:
    """The first bound that the value lies below; the number of bounds if there is none."""
    out = F.lit(len(upper_bounds))
    for i, bound in reversed(list(enumerate(upper_bounds))):
        out = F.when(column < bound, i).otherwise(out)
    return out


def by_list(column: Column, mapping: dict[int, list]) -> Column:
    """The partition whose list holds the value; 0 if there is none."""
    out = F.lit(0)
    for partition, values in reversed(list(mapping.items())):
        out = F.when(column.isin(values), partition).otherwise(out)
    return out


def round_robin(sequence: Column, n: int) -> Column:
    return F.pmod(sequence, F.lit(n)).cast("int")


def by_time(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)
