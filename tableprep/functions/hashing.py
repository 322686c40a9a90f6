"""Portable, partitioning-independent hashing.

``randomSplit`` / ``rand`` depend on how rows happen to be partitioned, so a
recomputed stage (lost executor) or another engine can place a row
differently.  Every sampling, split and fold decision in the library is
instead a pure function of the row's key: the first 32 bits of
``md5(seed || '|' || key)``.  DuckDB computes the same number with
``cast('0x' || substr(md5(seed || '|' || key), 1, 8) as bigint)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import quoted


def _key_string(key_cols: Sequence[str | Column], seed) -> Column:
    parts = [F.lit(str(seed))]
    for c in key_cols:
        col = quoted(c) if isinstance(c, str) else c
        parts.append(col.cast("string"))
    return F.concat_ws("|", *parts)


def hash_hex(key_cols: Sequence[str | Column], seed=42) -> Column:
    """md5 hex digest of the seeded key; a repeatable sort key."""
    return F.md5(_key_string(key_cols, seed))


def hash_u32(key_cols: Sequence[str | Column], seed=42) -> Column:
    """Unsigned 32-bit integer from the md5 of the seeded key."""
    return F.conv(F.substring(hash_hex(key_cols, seed), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key_cols: Sequence[str | Column], buckets: int, seed=42) -> Column:
    """Bucket in ``[0, buckets)`` from the seeded key."""
    return hash_u32(key_cols, seed) % F.lit(int(buckets))
