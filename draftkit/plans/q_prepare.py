"""Queries for normalisation, rendering/tokenising and the draft vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.functions.arrays import join_ints
from draftkit.operators import normalize as N
from draftkit.operators import tokens as TK
from draftkit.operators import vocab as V
from draftkit.plans import prepare as P
from draftkit.plans.catalog import register, table
from draftkit.plans.sqlgen import role_case, str_case, turn_tokens_ctes
from draftkit.operators.tokens import TEMPLATES, BOS_ORD

MAXLEN = 8192  # the reference's default sequence length
DRAFT_K = 512
TARGET_V = 131072
SEED = 42


def _conv(spark, sf):
    return table(spark, sf, "conversations")


def _duck_draw(key_sql: str, seed=SEED) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {key_sql})), 1, 8)) AS BIGINT)"


# ----------------------------------------------------------------- flagship
_VOCAB_SQL = f"""
WITH {turn_tokens_ctes('chatml', MAXLEN)},
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM toks GROUP BY token)),
masked AS (SELECT token, count(*) AS freq FROM toks WHERE trainable GROUP BY token),
freq AS (SELECT v.token_id, m.freq FROM masked m JOIN vocab v USING (token)),
sel0 AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT {DRAFT_K}),
pad AS (
  SELECT token_id FROM (
    SELECT r AS token_id, row_number() OVER (ORDER BY r) AS rn
    FROM range(0, {DRAFT_K}) t(r) WHERE r NOT IN (SELECT token_id FROM sel0))
  WHERE rn <= {DRAFT_K} - (SELECT count(*) FROM sel0)),
sel AS (SELECT token_id FROM sel0 UNION ALL SELECT token_id FROM pad),
d2t AS (SELECT token_id AS target_id, row_number() OVER (ORDER BY token_id) - 1 AS draft_id FROM sel)
SELECT d.draft_id::BIGINT AS draft_id, d.target_id::BIGINT AS target_id,
       (d.target_id - d.draft_id)::BIGINT AS "offset", v.token AS token,
       coalesce(f.freq, 0)::BIGINT AS freq
FROM d2t d LEFT JOIN freq f ON f.token_id = d.target_id
LEFT JOIN vocab v ON v.token_id = d.target_id
"""


def draft_vocab_query(spark, sf):
    return P.draft_vocabulary(_conv(spark, sf), "chatml", MAXLEN, DRAFT_K)


register("V5_draft_vocabulary", _VOCAB_SQL)(draft_vocab_query)


# ----------------------------------------------------------------- N group
@register("N1_role_aliases", f"""
SELECT conv_id, turn, {role_case('role')} AS role, coalesce(text, '') AS text
FROM conversations WHERE {role_case('role')} IS NOT NULL""")
def n1(spark, sf):
    return N.normalize_rows(_conv(spark, sf)).select("conv_id", "turn", "role", "text")


@register("N5_turn_dropout", f"""
WITH r AS (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
         count(*) OVER (PARTITION BY conv_id) AS len FROM conversations),
n AS (SELECT *, 1 + {_duck_draw('conv_id')} % len AS n FROM r),
c AS (SELECT conv_id, min(i) AS cut FROM n WHERE {role_case('role')} = 'assistant' AND i + 1 >= n GROUP BY conv_id)
SELECT n.conv_id, n.turn, n.role FROM n LEFT JOIN c USING (conv_id)
WHERE c.cut IS NULL OR n.i <= c.cut""")
def n5(spark, sf):
    return N.turn_dropout_rows(_conv(spark, sf), SEED).select("conv_id", "turn", "role")


@register("N16_fold_turns", """
SELECT conv_id, count(*)::BIGINT AS n_turns,
       string_agg(role, ',' ORDER BY turn) AS roles,
       sum(length(text))::BIGINT AS n_chars
FROM conversations GROUP BY conv_id""")
def n16(spark, sf):
    f = N.fold_turns(_conv(spark, sf))
    return f.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                    F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
                    F.aggregate("turns", F.lit(0).cast("bigint"),
                                lambda a, t: a + F.length(t["content"])).alias("n_chars"))


@register("N6_nested_normalize", f"""
SELECT conv_id, count(*)::BIGINT AS n_turns,
       string_agg({role_case('role')}, ',' ORDER BY turn) AS roles
FROM conversations WHERE {role_case('role')} IS NOT NULL
GROUP BY conv_id""")
def n6(spark, sf):
    raw = _conv(spark, sf).select("conv_id", "turn", F.struct(
        F.lit(None).cast("string").alias("from"), F.col("role"), F.lit(None).cast("string").alias("value"),
        F.col("text").alias("content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("thinking"),
        F.lit(None).cast("string").alias("reasoning_content")).alias("t"))
    nested = raw.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("_s"))
    nested = nested.select("conv_id", F.transform("_s", lambda x: x["t"]).alias("turns"))
    out = N.normalize_turns(nested, "turns")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                      F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"))


# ----------------------------------------------------------------- T group
_T1_TEMPLATE = "llama3"


@register("T1_render_pieces", f"""
WITH norm AS (SELECT conv_id, turn, {role_case('role')} AS role, coalesce(text,'') AS text FROM conversations),
p AS (
  SELECT conv_id, turn::BIGINT AS ord, role,
         {str_case('role', TEMPLATES[_T1_TEMPLATE].prefix)} || text || {str_case('role', TEMPLATES[_T1_TEMPLATE].suffix)} AS piece
  FROM norm WHERE role IS NOT NULL
  UNION ALL SELECT DISTINCT conv_id, {BOS_ORD}::BIGINT, 'bos', '{TEMPLATES[_T1_TEMPLATE].bos}' FROM norm)
SELECT conv_id, ord, role, md5(piece) AS piece_md5, length(piece)::BIGINT AS piece_len,
       coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
FROM p""")
def t1(spark, sf):
    rows = N.normalize_rows(_conv(spark, sf))
    r = TK.render_pieces(rows, TEMPLATES[_T1_TEMPLATE])
    return r.select("conv_id", "ord", "role", F.md5("piece").alias("piece_md5"),
                    F.length("piece").cast("bigint").alias("piece_len"), "char_start")


@register("T4_tokens_truncated", f"""
WITH {turn_tokens_ctes('llama3', MAXLEN)}
SELECT conv_id, pos::BIGINT AS pos, token, trainable FROM toks""")
def t4(spark, sf):
    return P.corpus_tokens(_conv(spark, sf), "llama3", MAXLEN).select("conv_id", "pos", "token", "trainable")


@register("T9_prepared_samples", f"""
WITH {turn_tokens_ctes('chatml', MAXLEN)},
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM toks GROUP BY token))
SELECT conv_id, string_agg(v.token_id::VARCHAR, ',' ORDER BY pos) AS input_ids,
       string_agg(CASE WHEN trainable THEN 'true' ELSE 'false' END, ',' ORDER BY pos) AS loss_mask,
       count(*)::BIGINT AS seq_len
FROM toks JOIN vocab v USING (token)
GROUP BY conv_id
HAVING count(*) FILTER (WHERE trainable) >= 10""")
def t9(spark, sf):
    s = P.prepared_samples(_conv(spark, sf), "chatml", MAXLEN, minimum_valid_tokens=10)
    return s.select("conv_id", join_ints("input_ids").alias("input_ids"),
                    join_ints("loss_mask").alias("loss_mask"), F.col("seq_len").cast("bigint"))


@register("T13_vocabulary_ids", f"""
WITH {turn_tokens_ctes('chatml', MAXLEN)}
SELECT token, (row_number() OVER (ORDER BY n DESC, token) - 1)::BIGINT AS token_id, n
FROM (SELECT token, count(*)::BIGINT AS n FROM toks GROUP BY token)""")
def t13(spark, sf):
    return TK.build_vocabulary(P.corpus_tokens(_conv(spark, sf), "chatml", MAXLEN)).select("token", "token_id", "n")


# ----------------------------------------------------------------- V group
def _freq(spark, sf):
    """V1 over prepared samples (tokenised once, into the shared folder)."""
    return V.token_frequency(P.prepared_samples(_conv(spark, sf), "chatml", MAXLEN))


_FREQ_CTE = f"""
WITH {turn_tokens_ctes('chatml', MAXLEN)},
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM toks GROUP BY token)),
freq AS (SELECT v.token_id, count(*) AS freq FROM toks JOIN vocab v USING (token) WHERE trainable GROUP BY v.token_id)"""


@register("V1_token_frequency", _FREQ_CTE + "\nSELECT token_id::BIGINT AS token_id, freq::BIGINT AS freq FROM freq")
def v1(spark, sf):
    return _freq(spark, sf)


@register("V2_combine_frequencies", _FREQ_CTE + """,
allf AS (SELECT v.token_id, count(*) AS freq FROM toks JOIN vocab v USING (token) GROUP BY v.token_id),
f2 AS (SELECT token_id, freq FROM freq UNION ALL SELECT token_id, freq FROM allf)
SELECT token_id::BIGINT AS token_id, sum(freq)::BIGINT AS freq FROM f2 GROUP BY token_id""")
def v2(spark, sf):
    """Trainable-token frequencies combined with all-token frequencies."""
    toks = P.corpus_tokens(_conv(spark, sf), "chatml", MAXLEN)
    vocab = TK.build_vocabulary(toks, extra_aggs=[F.count_if("trainable").alias("freq")])
    trainable = vocab.filter(F.col("freq") > 0).select("token_id", "freq")
    every = vocab.select("token_id", F.col("n").alias("freq"))
    return V.combine_frequencies(trainable, every)


@register("V3_top_k", _FREQ_CTE + f"""
SELECT token_id::BIGINT AS token_id, freq::BIGINT AS freq FROM freq ORDER BY freq DESC, token_id LIMIT {DRAFT_K}""")
def v3(spark, sf):
    return V.top_k(_freq(spark, sf), DRAFT_K)


_BIG_K = 40000


@register("V4_pad_selection", _FREQ_CTE + f""",
sel0 AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT {_BIG_K}),
pad AS (
  SELECT token_id FROM (
    SELECT r AS token_id, row_number() OVER (ORDER BY r) AS rn
    FROM range(0, {_BIG_K}) t(r) WHERE r NOT IN (SELECT token_id FROM sel0))
  WHERE rn <= {_BIG_K} - (SELECT count(*) FROM sel0))
SELECT token_id::BIGINT AS token_id, (token_id IN (SELECT token_id FROM sel0)) AS observed
FROM (SELECT token_id FROM sel0 UNION ALL SELECT token_id FROM pad)""")
def v4(spark, sf):
    f = _freq(spark, sf)
    sel0 = V.top_k(f, _BIG_K)
    sel = V.pad_selection(sel0, _BIG_K)
    return sel.join(sel0.select("token_id").withColumn("observed", F.lit(True)), "token_id", "left").select(
        "token_id", F.coalesce("observed", F.lit(False)).alias("observed"))


@register("V6_target_to_draft", _FREQ_CTE + f""",
sel AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT {DRAFT_K})
SELECT (r // 1024)::BIGINT AS block, count(*)::BIGINT AS n,
       count(*) FILTER (WHERE r IN (SELECT token_id FROM sel))::BIGINT AS n_in_draft
FROM range(0, {TARGET_V}) t(r) GROUP BY 1""")
def v6(spark, sf):
    sel = V.top_k(_freq(spark, sf), DRAFT_K)
    t2d = V.target_to_draft(sel, TARGET_V)
    return t2d.groupBy(F.floor(F.col("target_id") / 1024).cast("bigint").alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("in_draft").cast("bigint").alias("n_in_draft"))


@register("V7_map_draft_ids", _FREQ_CTE + f""",
sel AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT {DRAFT_K}),
d2t AS (SELECT row_number() OVER (ORDER BY token_id) - 1 AS draft_id, token_id - (row_number() OVER (ORDER BY token_id) - 1) AS off FROM sel),
pred AS (SELECT vec_id, (vec_id * 7) % {DRAFT_K} AS draft_id FROM embeddings)
SELECT p.vec_id, p.draft_id::BIGINT AS draft_id, (p.draft_id + d.off)::BIGINT AS target_id
FROM pred p LEFT JOIN d2t d USING (draft_id)""")
def v7(spark, sf):
    sel = V.top_k(_freq(spark, sf), DRAFT_K)
    d2t = V.draft_to_target(sel)
    pred = table(spark, sf, "embeddings").select("vec_id", ((F.col("vec_id") * 7) % DRAFT_K).cast("int").alias("draft_id"))
    return V.map_draft_ids(pred, d2t).select("vec_id", "draft_id", "target_id")


@register("V8_check_maps", f"""
SELECT {TARGET_V}::BIGINT AS t2d_len, {DRAFT_K}::BIGINT AS t2d_sum, {DRAFT_K}::BIGINT AS d2t_len, true AS ok""")
def v8(spark, sf):
    d2t, t2d = V.build_maps(_freq(spark, sf), DRAFT_K, TARGET_V)
    return V.check_maps(d2t, t2d, DRAFT_K, TARGET_V)
