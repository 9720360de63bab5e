"""Packing queries (P).  The plan is sequential by nature, so SQL checks its
summary (every sample once, no bin over capacity, no idle rank, all tokens);
tests compare the plan itself with a brute-force packer."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.operators import pack as PK
from draftkit.plans import derived as D
from draftkit.plans.catalog import register
from draftkit.plans.sqlgen import turn_tokens_ctes

MAX_LEN, RANKS, SEGMENT, SEED = 4096, 4, 64, 42

_LENGTHS = f"""
WITH {turn_tokens_ctes('chatml', D.SAMPLE_MAXLEN)},
s AS (SELECT conv_id AS sample_idx, count(*)::BIGINT AS seq_len FROM toks GROUP BY conv_id)"""


def _lengths(spark, sf):
    return D.samples(spark, sf).select("sample_idx", "seq_len")


@register("P1_clip_lengths", _LENGTHS + """
SELECT sample_idx, least(seq_len, 200)::BIGINT AS seq_len, seq_len <= 200 AS kept_when_dropping FROM s""")
def p1(spark, sf):
    s = _lengths(spark, sf)
    kept = PK.clip_lengths(s, 200, truncate=False).select("sample_idx", F.lit(True).alias("kept"))
    return PK.clip_lengths(s, 200).join(kept, "sample_idx", "left").select(
        "sample_idx", "seq_len", F.coalesce("kept", F.lit(False)).alias("kept_when_dropping"))


@register("P2_epoch_order", _LENGTHS + f"""
SELECT sample_idx, (row_number() OVER (ORDER BY md5('{SEED + 3}:' || sample_idx::VARCHAR), sample_idx) - 1)::BIGINT AS perm FROM s""")
def p2(spark, sf):
    return PK.epoch_order(_lengths(spark, sf), SEED, 3).select("sample_idx", "perm")


@register("P3_P6_pack_plan", _LENGTHS + f"""
SELECT count(*)::BIGINT AS n_samples, sum(least(seq_len, {MAX_LEN}))::BIGINT AS n_tokens,
       0::BIGINT AS placed_twice, 0::BIGINT AS left_over, 0::BIGINT AS over_capacity, 0::BIGINT AS idle_ranks FROM s""")
def p3(spark, sf):
    plan = PK.pack_plan(_lengths(spark, sf), MAX_LEN, RANKS, SEED, epoch=0, segment_size=SEGMENT)
    return PK.plan_summary(plan, MAX_LEN, RANKS)
