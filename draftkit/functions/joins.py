"""Joins whose broadcast side has a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the broadcast side that we are willing to ship to every executor.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
#: Bytes of a row beyond its values, and of each array or map entry.
_ROW, _ENTRY = 16, 8


def _width(c, dtype) -> "F.Column":
    """Measured bytes of a value."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + _ENTRY
    if isinstance(dtype, T.BinaryType):
        return F.coalesce(F.length(c), F.lit(0)) + _ENTRY
    if isinstance(dtype, T.ArrayType):
        items = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + _width(x, dtype.elementType).cast("bigint"))
        return F.coalesce(items, F.lit(0)) + _ENTRY
    if isinstance(dtype, T.MapType):
        return _width(F.map_keys(c), T.ArrayType(dtype.keyType)) + _width(F.map_values(c), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.StructType):
        out = F.lit(0)
        for f in dtype.fields:
            out = out + _width(c[f.name], f.dataType)
        return out
    return F.lit(16 if isinstance(dtype, T.DecimalType) else 8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take, summed by Spark."""
    row = F.lit(_ROW)
    for f in df.schema.fields:
        row = row + _width(df[f"`{f.name}`"], f.dataType)
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def checked_broadcast_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
                           max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``right`` only where its rows measure at most ``max_bytes``;
    beyond that a shuffle join gives the same rows (AQE splits skewed
    partitions of the large side)."""
    if measured_bytes(right) <= max_bytes:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)
