"""Deterministic pseudo-random columns.

``rand(seed)`` depends on partitioning, so a recomputed or repartitioned
stage would draw different numbers. Every random draw in kestrel is instead
a hash of (tag, key): the same row always draws the same number, whatever
the partitioning or retry history. The expression is plain SQL
(md5 → first 32 bits → [0,1)), so an external engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def hash_key(*parts) -> Column:
    """'-'-joined string key of the given columns/literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("-", *[c.cast("string") for c in cols])


def uniform(tag: str, *keys) -> Column:
    """u(tag, key) in [0,1): md5(tag-key), first 8 hex digits / 2^32."""
    h = F.md5(hash_key(F.lit(tag), *keys))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def hash_int(tag: str, *keys) -> Column:
    """Non-negative 32-bit integer from the same md5 prefix."""
    h = F.md5(hash_key(F.lit(tag), *keys))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def order_key(seed, *keys) -> Column:
    """Seeded shuffle key: md5(seed-key) hex string, total order, no ties
    unless keys collide."""
    return F.md5(hash_key(F.lit(str(seed)), *keys))
