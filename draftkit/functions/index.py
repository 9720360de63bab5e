"""Global positions and running sums without pulling data into one task.

An unpartitioned ``Window.orderBy`` moves every row to a single task.  The
helpers here keep the work distributed:

* ``dense_index``  -- 0-based position in a global sort order.  Rows are range
  partitioned and sorted by Spark, each partition counts its rows, the
  per-partition offsets (one row per partition, so its size is bounded by the
  partition count, not the data) are broadcast back.
* ``running_sum``  -- prefix sum inside groups that may be huge (one key can
  hold a third of all rows).  Rows are split into buckets of the ordering key;
  each bucket is summed locally, bucket totals get their own (much smaller)
  prefix sum, and the two are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit.session import materialize

_LOW33 = (1 << 33) - 1


def _cols(xs):
    return [x if isinstance(x, Column) else F.col(x) for x in xs]


def dense_index(df: DataFrame, order_cols, name: str = "row_idx") -> DataFrame:
    """Add ``name`` = 0-based rank of each row in ``order_cols`` order.

    The order must be total (include a unique id last) for a replayable
    result.  The sorted, tagged rows are written once to the shared
    checkpoint folder so that the counting pass and the numbering pass read
    identical rows even after an executor is lost.
    """
    tagged = df.orderBy(*_cols(order_cols)).withColumn("_mid", F.monotonically_increasing_id())
    # written once to the shared folder; the partition number travels inside
    # _mid, so the read-back layout does not matter
    tagged = materialize(tagged, "dense-index").withColumn("_pid", F.shiftright("_mid", 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: size bounded by the partition count.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33))).cast("bigint"))
    return out.drop("_pid", "_mid", "_off")


def running_sum(df: DataFrame, keys, order_cols, value, out: str,
                inclusive: bool = False, bucket: Column | None = None,
                bucket_width: int = 4096) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same ``keys``
    group in ``order_cols`` order (``inclusive`` adds the row itself).

    Groups are cut into buckets -- ``bucket`` if given (any expression that
    is monotone in the order, e.g. an hour number), else
    ``floor(first order column / bucket_width)`` -- so that no single window
    partition holds a whole hot group.  The order must be total within a
    group.
    """
    keys = list(keys)
    order_cols = [order_cols] if isinstance(order_cols, (str, Column)) else list(order_cols)
    v = value if isinstance(value, Column) else F.col(value)
    if bucket is None:
        bucket = _default_bucket(df, order_cols[0], bucket_width)
    d = df.withColumn("_v", v.cast("bigint")).withColumn("_b", bucket.cast("bigint"))
    w_bucket = Window.partitionBy(*keys, "_b")
    w_local = w_bucket.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # running sum inside the bucket and the bucket total from the same
    # exchange; the totals are derived from these rows (not recomputed from
    # the input), so the input is evaluated and shuffled once
    d = d.withColumn("_loc", F.sum("_v").over(w_local)).withColumn("_bt", F.sum("_v").over(w_bucket))
    tot = d.select(*keys, "_b", "_bt").dropDuplicates([*keys, "_b"])
    w_b = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select(*keys, "_b", F.coalesce(F.sum("_bt").over(w_b), F.lit(0)).alias("_bp"))
    d = d.join(pre, [*keys, "_b"])
    res = F.col("_bp") + F.col("_loc")
    if not inclusive:
        res = res - F.col("_v")
    return d.withColumn(out, res.cast("bigint")).drop("_v", "_b", "_loc", "_bp", "_bt")


def _default_bucket(df: DataFrame, first, width: int) -> Column:
    """Buckets along the first ordering column: ``width`` consecutive values
    of an integer column, or one hour of a timestamp column."""
    if isinstance(first, str):
        dt = df.schema[first].dataType
        col = F.col(first)
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(3_600_000_000))
        if isinstance(dt, T.DateType):
            return F.unix_date(col)
        return F.floor(col / F.lit(width))
    return F.floor(first / F.lit(width))


def group_rank(df: DataFrame, keys, order_col: str, out: str, bucket_width: int = 4096) -> DataFrame:
    """0-based position of each row inside its ``keys`` group (ordered by a
    unique integer ``order_col``), computed with ``running_sum``."""
    return running_sum(df, keys, order_col, F.lit(1), out, inclusive=False, bucket_width=bucket_width)
