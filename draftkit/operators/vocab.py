"""Draft vocabulary: token frequencies, top-k, gap filling and id maps.

Sizes: frequency tables are as large as the distinct-token set (bounded by
the target vocabulary); selections are bounded by the draft vocabulary size
``k``, a parameter.  Windows over a selection therefore run on at most ``k``
rows, and the ``d2t`` map (``k`` rows) is the only broadcast side.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_frequency(samples: DataFrame, ids_col: str = "input_ids", mask_col: str = "loss_mask") -> DataFrame:
    """V1: ``(token_id, freq)`` over trainable positions of prepared samples.

    ``explode(arrays_zip)`` is narrow; the ``groupBy`` runs a partial
    aggregate per task first, so hot tokens are combined before the shuffle.
    """
    z = samples.select(F.explode(F.arrays_zip(F.col(ids_col).alias("t"), F.col(mask_col).alias("m"))).alias("z"))
    return (z.filter(F.col("z.m").cast("boolean"))
             .groupBy(F.col("z.t").cast("int").alias("token_id"))
             .agg(F.count(F.lit(1)).alias("freq")))


def combine_frequencies(*freqs: DataFrame) -> DataFrame:
    """V2: sum several ``(token_id, freq)`` tables."""
    u = reduce(lambda a, b: a.unionByName(b), freqs)
    return u.groupBy("token_id").agg(F.sum("freq").cast("bigint").alias("freq"))


def top_k(freq: DataFrame, k: int) -> DataFrame:
    """V3: the ``k`` most frequent ids, ties to the smaller id
    (``TakeOrderedAndProject``: each task keeps its own top k)."""
    return freq.orderBy(F.col("freq").desc(), F.col("token_id")).limit(k)


def pad_selection(selected: DataFrame, k: int) -> DataFrame:
    """V4: fill up to ``k`` ids with the smallest unused ids in ``[0, k)``.

    Lazy, no join and no driver round trip: the selection (at most ``k``
    rows, first) and the unused ids of ``[0, k)`` (after) are numbered in one
    window over at most ``2k`` rows; the first ``k`` are kept."""
    spark = selected.sparkSession
    sel = selected.select("token_id")
    unused = (spark.range(k).select(F.col("id").cast("int").alias("token_id"))
              .join(sel, "token_id", "left_anti"))
    both = sel.withColumn("_pad", F.lit(0)).unionByName(unused.withColumn("_pad", F.lit(1)))
    w = Window.orderBy("_pad", "token_id")
    return both.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).select("token_id")


def draft_to_target(selected: DataFrame) -> DataFrame:
    """V5: ``d2t[i] = sorted_ids[i] - i``; rows ``(draft_id, target_id, offset)``.
    The window spans the selection only (at most ``k`` rows)."""
    w = Window.orderBy("token_id")
    d = selected.select("token_id").withColumn("draft_id", (F.row_number().over(w) - 1).cast("int"))
    return d.select("draft_id", F.col("token_id").alias("target_id"),
                    (F.col("token_id") - F.col("draft_id")).cast("bigint").alias("offset"))


def target_to_draft(selected: DataFrame, target_vocab_size: int) -> DataFrame:
    """V6: ``(target_id, in_draft)`` over the whole target vocabulary."""
    spark = selected.sparkSession
    sel = selected.select(F.col("token_id").alias("target_id")).withColumn("in_draft", F.lit(True))
    return (spark.range(target_vocab_size).select(F.col("id").cast("int").alias("target_id"))
            .join(sel, "target_id", "left")
            .select("target_id", F.coalesce("in_draft", F.lit(False)).alias("in_draft")))


def map_draft_ids(df: DataFrame, d2t: DataFrame, col: str = "draft_id", out: str = "target_id") -> DataFrame:
    """V7: draft id -> target id = ``id + d2t[id]`` (broadcast lookup; d2t
    has exactly draft-vocabulary-size rows)."""
    m = d2t.select(F.col("draft_id").alias(col), F.col("offset").alias("_off"))
    return df.join(F.broadcast(m), col, "left").withColumn(out, (F.col(col) + F.col("_off")).cast("int")).drop("_off")


def check_maps(d2t: DataFrame, t2d: DataFrame, draft_vocab_size: int, target_vocab_size: int) -> DataFrame:
    """V8: ``len(t2d) = target``, ``sum(t2d) = draft``, ``len(d2t) = draft``;
    one aggregation over both maps (no join), the job fails
    (``assert_true``) otherwise."""
    u = (t2d.select(F.lit(1).alias("_t"), F.col("in_draft"), F.lit(0).alias("_d"))
            .unionByName(d2t.select(F.lit(0).alias("_t"), F.lit(False).alias("in_draft"), F.lit(1).alias("_d"))))
    j = u.agg(F.sum("_t").cast("bigint").alias("t2d_len"), F.count_if("in_draft").cast("bigint").alias("t2d_sum"),
              F.sum("_d").cast("bigint").alias("d2t_len"))
    ok = ((F.col("t2d_len") == target_vocab_size) & (F.col("t2d_sum") == draft_vocab_size)
          & (F.col("d2t_len") == draft_vocab_size))
    return j.withColumn("ok", F.when(F.assert_true(ok, F.lit("vocabulary maps inconsistent")).isNull(), ok))


def build_maps(freq: DataFrame, draft_vocab_size: int, target_vocab_size: int):
    """V3-V6 end to end: ``(d2t, t2d)``."""
    sel = pad_selection(top_k(freq, draft_vocab_size), draft_vocab_size)
    return draft_to_target(sel), target_to_draft(sel, target_vocab_size)


def resolve_maps(d2t_path: str | None, t2d_path: str | None, cache_dir: str | None,
                 freq_path: str | None, exists=os.path.exists) -> str:
    """V9: lookup order explicit pair -> cached pair -> rebuild from
    frequencies -> none (full vocabulary).  Only one of a pair is an error.
    ``exists`` checks a path (pass ``sources.readers.path_exists`` bound to a
    session for cluster file systems)."""
    if bool(d2t_path) != bool(t2d_path):
        raise ValueError("give both d2t and t2d, or neither")
    if d2t_path:
        return "explicit"
    if cache_dir and exists(cache_dir.rstrip("/") + "/d2t/_SUCCESS") and \
            exists(cache_dir.rstrip("/") + "/t2d/_SUCCESS"):
        return "cached"
    if freq_path:
        return "rebuild"
    return "none"


def load_maps(spark, d2t_path: str | None, t2d_path: str | None, cache_dir: str | None, freq_path: str | None,
              draft_vocab_size: int, target_size: int):
    """V9: ``(how, d2t, t2d)`` by the lookup order of ``resolve_maps``.  A
    rebuild reads the frequencies, writes both maps to ``cache_dir`` (if
    given) and loads them from there; ``none`` has no maps."""
    from draftkit.sources.readers import path_exists
    from draftkit.sources.sinks import read_vocab_maps, write_vocab_maps
    how = resolve_maps(d2t_path, t2d_path, cache_dir, freq_path, lambda p: path_exists(spark, p))
    if how == "explicit":
        return how, spark.read.parquet(d2t_path), spark.read.parquet(t2d_path)
    if how == "none":
        return how, None, None
    if how == "rebuild":
        d2t, t2d = build_maps(spark.read.parquet(freq_path), draft_vocab_size, target_size)
        if not cache_dir:
            return how, d2t, t2d
        write_vocab_maps(d2t, t2d, cache_dir)
    return (how, *read_vocab_maps(spark, cache_dir))


def target_vocab_size(size: int | None, model_path: str | None) -> int:
    """Exactly one of a size or a model must be given (size only here)."""
    if size is not None and model_path is not None:
        raise ValueError("give a target vocabulary size or a target model, not both")
    if size is None and model_path is None:
        raise ValueError("give a target vocabulary size or a target model")
    if size is None:
        raise ValueError("reading the vocabulary size from a model is not supported; pass the size")
    return size
