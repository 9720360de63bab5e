"""The first n rows of an order, for an n of any size.

``orderBy(...).limit(n)`` ends in one task that holds n whole rows.  Here the
n-th row's order values are found on narrow rows -- counts over 2^16 ranges
of the leading value say which range holds rank n, and only that range is
looked at again -- and the rows up to it are kept by a filter where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit.functions.index import dense_index
from draftkit.session import materialize

#: Ranges counted at a time, as bits.
RANGE_BITS = 16
#: Narrow rows of one range that one sort may settle; a larger range whose
#: leading values are all the same is numbered by the distributed index.
SETTLE = 100_000

_NULL = -(1 << 63)


def leading_value(df: DataFrame, name: str) -> Column:
    """A long that never falls where the column rises: whole numbers as they
    are, instants in microseconds, of strings the first seven bytes; null is
    the least."""
    c, kind = df[f"`{name}`"], df.schema[name].dataType
    if isinstance(kind, T.StringType):
        c = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c).cast("bigint")
    elif isinstance(kind, T.IntegralType):
        c = c.cast("bigint")
    else:
        raise TypeError(f"no order of ranges for {name} ({kind.simpleString()})")
    return F.coalesce(c, F.lit(_NULL).cast("bigint"))


def first_in_order(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of ``df`` in ascending order of the columns
    ``order`` (nulls first), as a filter: rows don't move.  Of rows that
    agree in all of ``order`` where the cut falls, any that make up the
    number are kept.  ``df`` is evaluated twice, first for the order columns
    alone."""
    if n <= 0:
        return df.where(F.lit(False))
    keys = materialize(df.select(leading_value(df, order[0]).alias("_lead"), F.struct(*order).alias("_order")), "order-keys")
    lo, hi, total = keys.agg(F.min("_lead"), F.max("_lead"), F.count(F.lit(1))).first()
    if total <= n:
        return df
    rank, shift, inside = n - 1, 0, total  # of the cut among the rows in [lo, hi]
    while inside > SETTLE and lo < hi:
        shift = max((hi - lo).bit_length() - RANGE_BITS, 0)
        counts = keys.where(F.col("_lead").between(lo, hi)).groupBy(F.shiftright("_lead", shift).alias("r")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(counts.collect()):  # 2^16 + 1 ranges at most
            if rank < r.n:
                break
            rank -= r.n
        lo, hi, inside = max(lo, r.r << shift), min(hi, (r.r + 1 << shift) - 1), r.n
    part = keys.where(F.col("_lead").between(lo, hi)).select("_order")
    if inside <= SETTLE:
        cut = part.orderBy("_order").limit(rank + 1).agg(F.max("_order").alias("_order")).first()[0]
    else:
        cut = dense_index(part, ["_order"], "_i").where(F.col("_i") == rank).first()["_order"]
    at = F.struct(*[F.lit(cut[c]).cast(df.schema[c].dataType).alias(c) for c in order])
    here = F.struct(*order)
    upto = keys.agg(F.count_if(F.col("_order") < at), F.count_if(F.col("_order") <= at)).first()
    if upto[1] == n:
        return df.where(here <= at)
    # more rows agree with the cut than there is room for
    same = dense_index(df.where(here == at), list(order), "_tie").where(F.col("_tie") < n - upto[0]).drop("_tie")
    return df.where(here < at).unionByName(same)
