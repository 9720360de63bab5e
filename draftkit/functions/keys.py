"""Keyed hash draws: replayable randomness that does not depend on partitioning.

``rand(seed)`` depends on the partition layout, so the same seed gives other
draws after a repartition or on another cluster size.  Every random choice in
draftkit is instead a hash of ``(seed, key...)``: the first 32 bits of
``md5(seed:key1:key2...)`` read as an unsigned integer.  DuckDB spells the same
draw ``cast('0x' || substr(md5(k), 1, 8) as bigint)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def draw_key(seed, *keys) -> Column:
    """``seed:key1:key2`` as one string (the hashed text)."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.concat_ws(":", *parts)


def hash32(seed, *keys) -> Column:
    """Unsigned 32-bit draw in ``[0, 2^32)`` as bigint."""
    return F.conv(F.substring(F.md5(draw_key(seed, *keys)), 1, 8), 16, 10).cast("bigint")


def draw_int(seed, n, *keys) -> Column:
    """Integer in ``[0, n)`` (``n`` may be a column)."""
    return F.pmod(hash32(seed, *keys), _c(n) if not isinstance(n, int) else F.lit(n))


def draw_uniform(seed, *keys) -> Column:
    """Double in ``[0, 1)``."""
    return hash32(seed, *keys) / F.lit(TWO_32)


def order_key(seed, *keys) -> Column:
    """Sort key of a seeded permutation: the full md5 text (ties break on ids)."""
    return F.md5(draw_key(seed, *keys))
