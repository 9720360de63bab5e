"""Packing samples into fixed-capacity batches across ranks.

The definition, at every size of the input:

* An epoch's permuted order is cut into segments of ``segment_size``
  consecutive samples.  A segment is packed by itself, front to back: a
  batch is the longest run of the samples that come next which fits into one
  bin per rank, when the longest sample goes first and each goes to the
  emptiest bin.
* Fewer than ``ranks`` samples may be left at a segment's end.  The leftovers
  of consecutive segments, as many segments as fill one, form the segments
  of the next round, until one round has a single segment.

Every segment is a grouped-map task over at most ``segment_size`` narrow
rows, so the plan needs no task that grows with the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftkit.functions.index import dense_index
from draftkit.functions.keys import order_key
from draftkit.session import materialize

PLAN_SCHEMA = "segment long, batch long, rank int, ord int, sample_idx long, len long, perm long"
#: Samples of a segment.
SEGMENT_SIZE = 4096


# ------------------------------------------------------------------ P1 / P2
def clip_lengths(df: DataFrame, max_len: int, truncate: bool = True, len_col: str = "seq_len") -> DataFrame:
    """Samples longer than ``max_len`` are cut to it (default) or dropped."""
    if truncate:
        return df.withColumn(len_col, F.least(F.col(len_col), F.lit(max_len)))
    return df.filter(F.col(len_col) <= max_len)


def epoch_order(df: DataFrame, seed: int, epoch: int, key: str = "sample_idx") -> DataFrame:
    """The permutation of epoch ``epoch``: position in
    ``md5(seed+epoch:key), key`` order (``perm``)."""
    return dense_index(df.withColumn("_h", order_key(seed + epoch, key)), ["_h", key], "perm").drop("_h")


# ------------------------------------------------------------------ P3 / P4
def spread(lengths: list[int], capacity: int, ranks: int) -> list[list[int]] | None:
    """Positions per rank when the longest sample goes first, each to the
    emptiest rank (of several, the lowest); of equal lengths the later one
    goes first.  ``None`` if a rank would overflow."""
    loads = [0] * ranks
    members: list[list[int]] = [[] for _ in range(ranks)]
    for n, i in sorted(((n, i) for i, n in enumerate(lengths)), reverse=True):
        rank = loads.index(min(loads))
        loads[rank] += n
        if loads[rank] > capacity:
            return None
        members[rank].append(i)
    return members


def longest_run(lengths: list[int], capacity: int, ranks: int) -> list[list[int]]:
    """The longest run from the front that ``spread`` can place.  No run
    with more than ``ranks`` full bins of tokens can, so the search starts
    there and gives up one sample at a time."""
    total, n = 0, 0
    while n < len(lengths) and total + lengths[n] <= capacity * ranks:
        total += lengths[n]
        n += 1
    for k in range(n, 0, -1):
        placed = spread(lengths[:k], capacity, ranks)
        if placed is not None:
            return placed
    raise ValueError("a sample is longer than a bin; clip lengths first")


def pack_run(lengths: list[int], capacity: int, ranks: int) -> tuple[list[list[list[int]]], int]:
    """The batches of one segment (a list per rank of positions), and
    the position from which fewer than ``ranks`` samples are left."""
    batches, at = [], 0
    while len(lengths) - at >= ranks:
        batch = longest_run(lengths[at:], capacity, ranks)
        batches.append([[at + i for i in rank] for rank in batch])
        at += sum(map(len, batch))
    return batches, at


def _pack_segment(capacity: int, ranks: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("perm").reset_index(drop=True)
        batches, rest = pack_run(rows["len"].tolist(), capacity, ranks)
        place = [(b, r, o, i) for b, batch in enumerate(batches) for r, members in enumerate(batch) for o, i in enumerate(members)]
        place += [(-1, -1, o, i) for o, i in enumerate(range(rest, len(rows)))]
        out = rows.iloc[[p[3] for p in place]].reset_index(drop=True)
        for k, c in enumerate(("batch", "rank", "ord")):
            out[c] = [p[k] for p in place]
        return out[[f.split()[0] for f in PLAN_SCHEMA.split(", ")]]
    return run


def pack_plan(lengths: DataFrame, max_len: int, ranks: int, seed: int, epoch: int,
              segment_size: int = SEGMENT_SIZE, key: str = "sample_idx", len_col: str = "seq_len",
              truncate: bool = True) -> DataFrame:
    """The packing plan of one epoch for all ranks:
    ``(epoch, batch_id, rank, ord, sample_idx, len)``; samples that could not
    be packed (fewer than ``ranks`` left in the last round's single segment)
    have a NULL ``batch_id``.  The plan depends on the samples and the
    parameters alone.  Every rank reads the same table (write it
    ``partitionBy("rank")``)."""
    if segment_size < 2 * ranks:
        raise ValueError("a segment must hold at least two samples per rank")
    d = clip_lengths(lengths.select(key, len_col), max_len, truncate, len_col)
    d = epoch_order(d, seed, epoch, key).select(F.col(key).alias("sample_idx"), F.col(len_col).cast("long").alias("len"), "perm")
    d = d.withColumn("segment", F.floor(F.col("perm") / segment_size).cast("long"))
    joined = max(2, segment_size // ranks)  # leftovers of so many segments make one
    rounds, last = [], None
    while True:
        # one narrow row per sample (later rounds: per leftover), written so
        # that the next round and the result read the same rows
        done = materialize(d.groupBy("segment").applyInPandas(_pack_segment(max_len, ranks), PLAN_SCHEMA), "pack-round")
        rounds.append(done.filter(F.col("batch") >= 0).withColumn("round", F.lit(len(rounds))))
        last = done.agg(F.max("segment")).first()[0]
        left = done.filter(F.col("batch") < 0).select("sample_idx", "len", "perm", F.floor(F.col("segment") / joined).cast("long").alias("segment"))
        if not last:
            break
        d = left
    packed = rounds[0]
    for r in rounds[1:]:
        packed = packed.unionByName(r)
    # global batch ids from the batches of each (round, segment): a running
    # sum over one row per segment, cut into buckets of its own
    per = packed.groupBy("round", "segment").agg((F.max("batch") + 1).alias("n"))
    per = per.withColumn("bucket", F.floor(F.col("segment") / SEGMENT_SIZE))
    inside = Window.partitionBy("round", "bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy(F.col("round").alias("r"), F.col("bucket").alias("b")).agg(F.sum("n").alias("n"))
    before = Window.orderBy("r", "b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("r", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    first = per.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        totals, (F.col("round") == F.col("r")) & (F.col("bucket") == F.col("b"))).select(
        F.col("round").alias("r"), F.col("segment").alias("s"), (F.col("off") + F.col("inside")).alias("first"))
    out = packed.join(first, (F.col("round") == F.col("r")) & (F.col("segment") == F.col("s")))
    out = out.select((F.col("first") + F.col("batch")).cast("long").alias("batch_id"), "rank", "ord", "sample_idx", "len")
    rest = left.select(F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("int").alias("rank"),
                       F.lit(None).cast("int").alias("ord"), "sample_idx", "len")
    return out.unionByName(rest).select(F.lit(epoch).alias("epoch"), "*")


def write_plan(plan: DataFrame, path: str) -> None:
    """One folder per rank so each rank reads only its own batches."""
    plan.filter(F.col("batch_id").isNotNull()).write.mode("overwrite").partitionBy("rank").parquet(path)


def plan_summary(plan: DataFrame, max_len: int, ranks: int) -> DataFrame:
    """One row: samples, tokens, samples placed more than once, bins over
    capacity, batches with an idle rank, and samples left over beyond the
    ``ranks - 1`` that may be."""
    bins = plan.filter(F.col("batch_id").isNotNull()).groupBy("batch_id", "rank").agg(F.sum("len").alias("fill"))
    batches = bins.groupBy("batch_id").agg(F.count(F.lit(1)).alias("used"), F.count_if(F.col("fill") > max_len).alias("over"))
    worst = batches.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("over_capacity"), F.count_if(F.col("used") < ranks).alias("idle_ranks"))
    per = plan.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"), F.count_if(F.col("batch_id").isNull()).alias("left"))
    all_ = per.agg(F.count(F.lit(1)).alias("n_samples"), F.coalesce(F.sum("len"), F.lit(0)).alias("n_tokens"),
                   F.count_if(F.col("n") > 1).alias("placed_twice"),
                   F.greatest(F.coalesce(F.sum("left"), F.lit(0)) - (ranks - 1), F.lit(0)).alias("left_over"))
    return all_.crossJoin(F.broadcast(worst))  # one row beside one row
