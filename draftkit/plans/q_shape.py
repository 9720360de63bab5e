"""Queries for sequence shaping (Q) over prepared samples and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.functions.arrays import join_ints
from draftkit.operators import shape as Q
from draftkit.plans import derived as D
from draftkit.plans.catalog import round6, register, table
from draftkit.plans.sqlgen import hx, sample_tokens_ctes

SEED = 42
_S = sample_tokens_ctes(D.SAMPLE_MAXLEN, D.HASH_VOCAB)


def _a2s(x: str) -> str:
    return f"array_to_string({x}, ',')"


@register("Q1_sample_lengths", f"WITH {_S} SELECT sample_idx, seq_len::BIGINT AS seq_len FROM samples")
def q1(spark, sf):
    return Q.sample_lengths(D.samples(spark, sf))


@register("Q2_positions", f"""
WITH {_S}
SELECT sample_idx, seq_len::VARCHAR AS lengths,
       array_to_string(CASE WHEN seq_len > 0 THEN generate_series(0, seq_len - 1) ELSE [] END, ',') AS position_ids
FROM samples""")
def q2(spark, sf):
    s = Q.with_positions(D.samples(spark, sf))
    return s.select("sample_idx", join_ints("lengths").alias("lengths"), join_ints("position_ids").alias("position_ids"))


@register("Q5_cut_or_pad", f"""
WITH {_S}
SELECT sample_idx, array_to_string(CASE WHEN len(input_ids) >= 128 THEN input_ids[1:128]
       ELSE list_concat(input_ids, list_transform(generate_series(1, 128 - len(input_ids)), lambda x: 0)) END, ',') AS input_ids
FROM samples""")
def q5(spark, sf):
    s = D.samples(spark, sf)
    return s.select("sample_idx", join_ints(Q.cut_or_pad("input_ids", 128, 0)).alias("input_ids"))


@register("Q6_next_token_shift", f"""
WITH {_S}
SELECT sample_idx, {_a2s('input_ids[2:]')} AS input_ids, {_a2s('loss_mask[2:]')} AS loss_mask,
       {_a2s('generate_series(1, seq_len - 1)')} AS position_ids,
       greatest(seq_len - 1, 0)::VARCHAR AS lengths
FROM samples""")
def q6(spark, sf):
    s = Q.with_positions(D.samples(spark, sf))
    t = Q.next_token_shift(s)
    return t.select("sample_idx", join_ints("input_ids").alias("input_ids"), join_ints("loss_mask").alias("loss_mask"),
                    join_ints("position_ids").alias("position_ids"), join_ints("lengths").alias("lengths"))


_U3_COLS = ["input_ids", "loss_mask", "position_ids", "lengths", "hidden_states", "verifier"]


def _u3_sql(draft: str, shifted: bool, last: str = "verifier") -> str:
    first, hid = ("[2:]", "[:-2]") if shifted else ("", "")
    pos = "CASE WHEN seq_len > 0 THEN generate_series(0, seq_len - 1) ELSE [] END"
    return f"""SELECT '{draft}' AS draft, sample_idx, {_a2s('input_ids' + first)} AS input_ids, {_a2s('loss_mask' + first)} AS loss_mask,
  {_a2s(f'({pos}){first}')} AS position_ids, {'greatest(seq_len - 1, 0)' if shifted else 'seq_len'}::VARCHAR AS lengths,
  {_a2s(f'list_transform(input_ids, lambda x: 2 * x){hid}')} AS hidden_states, {_a2s(f'list_transform(input_ids, lambda x: 3 * x){first}')} AS verifier,
  '{last}' AS verifier_column FROM samples"""


@register("U3_preprocess_by_draft_type", f"""
WITH {_S}
{_u3_sql('next_token', True, 'verifier_last_hidden_states')} UNION ALL {_u3_sql('parallel', True, 'verifier_last_hidden_states')}
UNION ALL {_u3_sql('block', False, 'verifier_last_hidden_states')} UNION ALL {_u3_sql('multi_token', False, 'hidden_states_last')}""")
def u3(spark, sf):
    """Every draft type's hook on the same samples, two and three times the
    ids standing in for hidden and verifier states."""
    s = Q.with_positions(D.samples(spark, sf)).withColumns({
        "hidden_states": F.transform("input_ids", lambda x: x.cast("bigint") * 2),
        "verifier_last_hidden_states": F.transform("input_ids", lambda x: x.cast("bigint") * 3)})
    out = None
    for draft in ("next_token", "parallel", "block", "multi_token"):
        t = s.transform(Q.PREPROCESS[draft])
        last = next(c for c in t.columns if c in ("verifier_last_hidden_states", "hidden_states_last"))
        t = t.withColumn("verifier", F.col(last)).select(F.lit(draft).alias("draft"), "sample_idx", *[join_ints(c).alias(c) for c in _U3_COLS],
                                                         F.lit(last).alias("verifier_column"))
        out = t if out is None else out.unionByName(t)
    return out


@register("Q14_off_policy_inputs", f"""
WITH {_S}
SELECT sample_idx, {_a2s("list_concat(input_ids[3:], list_transform(generate_series(1, least(2, len(input_ids))), lambda x: 0))")} AS step1_inputs
FROM samples""")
def q14(spark, sf):
    s = D.samples(spark, sf)
    return s.select("sample_idx", join_ints(Q.off_policy_inputs(F.col("input_ids"), 1)).alias("step1_inputs"))


_EMB_LONG = """
hl AS (
  SELECT vec_id // 40 AS sample_idx, (vec_id % 40) // 4 AS pos, vec_id % 4 AS layer,
         list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"""


def _emb_long(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") / 40).cast("bigint").alias("sample_idx"),
                    ((F.col("vec_id") % 40) / 4).cast("bigint").alias("pos"),
                    (F.col("vec_id") % 4).alias("layer"), F.col("embedding").alias("vec"))


@register("Q3_split_layers_long", f"""
WITH {_EMB_LONG},
g AS (SELECT sample_idx, pos, list(vec ORDER BY layer) AS l FROM hl GROUP BY sample_idx, pos)
SELECT sample_idx, pos, (len(l) - 1) * len(l[1]) AS n_hidden,
       (floor((list_sum(flatten(l[1:len(l) - 1]))) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS hidden_sum,
       (floor((list_sum(l[len(l)])) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS last_sum
FROM g""")
def q3(spark, sf):
    d = Q.split_layers_long(_emb_long(spark, sf))
    tot = lambda c: round6(F.aggregate(F.col(c), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")))
    return d.select("sample_idx", "pos", F.size("hidden_states").cast("bigint").alias("n_hidden"),
                    tot("hidden_states").alias("hidden_sum"), tot("verifier_last_hidden_states").alias("last_sum"))


@register("Q4_split_layers_nested", f"""
WITH {_EMB_LONG},
g AS (SELECT sample_idx, pos, list(vec ORDER BY layer) AS l FROM hl GROUP BY sample_idx, pos)
SELECT sample_idx, pos, (floor((list_sum(flatten(l[1:len(l) - 1]))) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS hidden_sum,
       (floor((list_sum(l[len(l)])) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS last_sum FROM g""")
def q4(spark, sf):
    e = _emb_long(spark, sf)
    nested = e.groupBy("sample_idx", "pos").agg(F.sort_array(F.collect_list(F.struct("layer", "vec"))).alias("_l"))
    nested = nested.select("sample_idx", "pos", F.transform("_l", lambda x: x["vec"]).alias("layers"))
    hid, last = Q.split_layers_nested(F.col("layers"))
    tot = lambda c: round6(F.aggregate(c, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")))
    return nested.select("sample_idx", "pos", tot(hid).alias("hidden_sum"), tot(last).alias("last_sum"))


@register("Q8_uniform_noise", f"""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings)
SELECT vec_id, (floor((sum(x + 2.0 * ({hx("concat_ws(':', '42', vec_id::VARCHAR, i::VARCHAR)")} / 4294967296.0 - 0.5) * 0.05)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS noisy_sum
FROM e GROUP BY vec_id""")
def q8(spark, sf):
    e = table(spark, sf, "embeddings")
    n = Q.uniform_noise(F.col("embedding"), SEED, F.col("vec_id"), 0.05)
    return e.select("vec_id", round6(F.aggregate(n, F.lit(0.0).cast("double"), lambda a, x: a + x)).alias("noisy_sum"))


@register("Q8_gaussian_noise", f"""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings),
d AS (SELECT vec_id, x, ({hx("concat_ws(':', '42', vec_id::VARCHAR, i::VARCHAR, 'a')")} + 1) / 4294967297.0 AS u1,
             {hx("concat_ws(':', '42', vec_id::VARCHAR, i::VARCHAR, 'b')")} / 4294967296.0 AS u2 FROM e)
SELECT vec_id, (floor((sum(x + sqrt(-2.0 * ln(u1)) * cos(6.283185307179586 * u2) * 0.05)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS noisy_sum,
       (floor((sum(-2.0 * ln(u1) * pow(cos(6.283185307179586 * u2), 2))) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS draw_squares
FROM d GROUP BY vec_id""")
def q8g(spark, sf):
    """Noise added to whole vectors, and the squares of the normal draws."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("n", Q.gaussian_noise(F.col("v"), SEED, F.col("vec_id"), 0.05))
    add = lambda a, x: a + x
    zero = F.lit(0.0).cast("double")
    draws = F.zip_with("n", "v", lambda n, v: F.pow((n - v) / F.lit(0.05), F.lit(2.0)))
    return e.select("vec_id", round6(F.aggregate("n", zero, add)).alias("noisy_sum"), round6(F.aggregate(draws, zero, add)).alias("draw_squares"))


_BATCH = f"""
mem AS (SELECT sample_idx // 4 AS batch_id, sample_idx AS ord, input_ids, seq_len FROM samples)"""


def _members(spark, sf):
    s = D.samples(spark, sf)
    return s.select((F.col("sample_idx") / 4).cast("bigint").alias("batch_id"), F.col("sample_idx").alias("ord"),
                    "input_ids", F.col("seq_len").alias("len"))


@register("Q10_collate", f"""
WITH {_S}, {_BATCH},
c AS (SELECT batch_id, flatten(list(input_ids ORDER BY ord)) AS ids, list(len(input_ids) ORDER BY ord) AS lens FROM mem GROUP BY batch_id)
SELECT batch_id, {_a2s("CASE WHEN len(ids) >= 8192 THEN ids[1:8192] ELSE list_concat(ids, list_transform(generate_series(1, 8192 - len(ids)), lambda x: 0)) END")} AS input_ids,
       {_a2s('lens')} AS raw_lengths
FROM c""")
def q10(spark, sf):
    c = Q.collate(_members(spark, sf), None, 8192, ["input_ids"])
    return c.select("batch_id", join_ints("input_ids").alias("input_ids"), join_ints("raw_lengths").alias("raw_lengths"))


@register("Q11_empty_batches", f"""
WITH {_S}, {_BATCH},
spine AS (SELECT unnest(generate_series(0, (SELECT max(batch_id) + 3 FROM mem))) AS batch_id),
c AS (SELECT batch_id, flatten(list(input_ids ORDER BY ord)) AS ids FROM mem GROUP BY batch_id),
j AS (SELECT s.batch_id, coalesce(c.ids, []) AS ids FROM spine s LEFT JOIN c USING (batch_id))
SELECT batch_id, {_a2s("CASE WHEN len(ids) >= 8192 THEN ids[1:8192] ELSE list_concat(ids, list_transform(generate_series(1, 8192 - len(ids)), lambda x: 0)) END")} AS input_ids
FROM j""")
def q11(spark, sf):
    m = _members(spark, sf)
    spine = m.agg((F.max("batch_id") + 3).alias("_m")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m"))).alias("batch_id"))
    c = Q.collate(m, spine, 8192, ["input_ids"])
    return c.select("batch_id", join_ints("input_ids").alias("input_ids"))


@register("Q12_kept_lengths", f"""
WITH {_S}, {_BATCH},
p AS (SELECT *, coalesce(sum(seq_len) OVER (PARTITION BY batch_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prev FROM mem)
SELECT batch_id, ord, least(seq_len, 2048 - prev)::BIGINT AS kept_len FROM p WHERE prev < 2048""")
def q12(spark, sf):
    return Q.kept_lengths(_members(spark, sf), 2048).select("batch_id", "ord", "kept_len")


@register("Q13_document_ids", f"""
WITH {_S}, {_BATCH},
p AS (SELECT *, coalesce(sum(seq_len) OVER (PARTITION BY batch_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prev FROM mem),
k AS (SELECT batch_id, ord, least(seq_len, 2048 - prev) AS kl FROM p WHERE prev < 2048),
r AS (SELECT batch_id, ord, kl, row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1 AS i FROM k),
ids AS (SELECT batch_id, flatten(list(list_transform(generate_series(1, kl), lambda x: i) ORDER BY ord)) AS d FROM r GROUP BY batch_id)
SELECT batch_id, {_a2s("list_concat(d, list_transform(generate_series(1, 2048 - len(d)), lambda x: -1))")} AS doc_ids FROM ids""")
def q13(spark, sf):
    k = Q.kept_lengths(_members(spark, sf), 2048)
    g = k.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("ord", "kept_len"))).alias("_k"))
    lengths = F.transform("_k", lambda x: x["kept_len"])
    return g.select("batch_id", join_ints(Q.document_ids(lengths, 2048)).alias("doc_ids"))


@register("Q15_mtp_steps", f"""
WITH {_S},
n AS (SELECT sample_idx, count(*) AS n FROM stok GROUP BY sample_idx),
ks AS (SELECT unnest(generate_series(0, 2)) AS k)
SELECT a.sample_idx, a.pos, ks.k::BIGINT AS step, b.token AS input_token,
       CASE WHEN c.mask THEN c.token ELSE -100 END AS target
FROM stok a JOIN n USING (sample_idx) CROSS JOIN ks
JOIN stok b ON b.sample_idx = a.sample_idx AND b.pos = a.pos + ks.k + 1
JOIN stok c ON c.sample_idx = a.sample_idx AND c.pos = a.pos + ks.k + 2
WHERE a.pos < n.n - (ks.k + 2)""")
def q15(spark, sf):
    return Q.mtp_steps_arrays(D.samples(spark, sf), 3)


@register("Q16_step_alignment", f"""
WITH {_S}
SELECT a.sample_idx, a.pos, b.token AS target_k, b.mask AS mask_k
FROM stok a JOIN stok b ON b.sample_idx = a.sample_idx AND b.pos = a.pos + 2""")
def q16(spark, sf):
    return Q.step_alignment_arrays(D.samples(spark, sf), 2)


_ANCH = f"""
nn AS (SELECT sample_idx, max(pos) + 1 AS n FROM stok GROUP BY sample_idx),
cand AS (
  SELECT s.sample_idx, s.pos, row_number() OVER (PARTITION BY s.sample_idx
         ORDER BY md5(concat_ws(':', '42', s.sample_idx::VARCHAR, s.pos::VARCHAR)), s.pos) - 1 AS slot
  FROM stok s JOIN nn USING (sample_idx) WHERE s.mask AND s.pos < nn.n - 4),
spine AS (SELECT DISTINCT sample_idx, unnest(generate_series(0, 7)) AS slot FROM stok),
anchors AS (
  SELECT sp.sample_idx, sp.slot, coalesce(c.pos, 0) AS anchor, c.pos IS NOT NULL AS valid
  FROM spine sp LEFT JOIN cand c ON c.sample_idx = sp.sample_idx AND c.slot = sp.slot)"""


@register("Q17_select_anchors", f"WITH {_S}, {_ANCH} SELECT sample_idx, slot::BIGINT AS slot, anchor::BIGINT AS anchor, valid FROM anchors")
def q17(spark, sf):
    a = Q.anchors_arrays(D.samples(spark, sf), 8, 4, SEED)
    return a.select("sample_idx", F.inline("anchors"))


@register("Q18_21_block_targets", f"""
WITH {_S}, {_ANCH},
bp AS (SELECT sample_idx, slot, anchor, valid, unnest(generate_series(0, 3)) AS "offset" FROM anchors),
b AS (SELECT *, anchor + "offset" AS position FROM bp)
SELECT b.sample_idx, b.slot::BIGINT AS slot, b."offset"::BIGINT AS "offset", b.position::BIGINT AS position,
       CASE WHEN b."offset" = 0 OR NOT b.valid THEN 0 ELSE t.mask::INTEGER END::BIGINT AS block_mask,
       CASE WHEN b."offset" = 0 THEN t.token ELSE 49999 END::BIGINT AS block_input,
       p.token::BIGINT AS target
FROM b JOIN nn USING (sample_idx)
LEFT JOIN stok t ON t.sample_idx = b.sample_idx AND t.pos = b.position
LEFT JOIN stok p ON p.sample_idx = b.sample_idx AND p.pos = ((b.position - 1) % nn.n + nn.n) % nn.n""")
def q18(spark, sf):
    a = Q.anchors_arrays(D.samples(spark, sf), 8, 4, SEED)
    return Q.block_targets_arrays(a, 4, 49999)


_COD = """
valid AS (SELECT sample_idx, pos FROM stok WHERE mask),
cst AS (SELECT sample_idx, max(pos) + 1 AS n, count(*) FILTER (WHERE mask) AS v FROM stok GROUP BY sample_idx),
d1p AS (
  SELECT p.sample_idx, p.pos, cst.n, floor(greatest(cst.v - 1, 0) * {r1}::DOUBLE)::INTEGER AS sz,
         row_number() OVER (PARTITION BY p.sample_idx ORDER BY md5(concat_ws(':', '42', p.sample_idx::VARCHAR, '1', p.pos::VARCHAR)), p.pos) AS r,
         count(*) OVER (PARTITION BY p.sample_idx) AS pn
  FROM valid p JOIN cst USING (sample_idx)),
d1 AS (SELECT sample_idx, pos, n FROM d1p WHERE sz > 0 AND (r <= sz OR pn < sz)),
pool2 AS (
  SELECT x.sample_idx, x.pos FROM (SELECT sample_idx, (pos + 1) % n AS pos FROM d1) x
  WHERE x.pos <> 0 AND EXISTS (SELECT 1 FROM valid v WHERE v.sample_idx = x.sample_idx AND v.pos = x.pos)),
d2p AS (
  SELECT p.sample_idx, p.pos, cst.n, floor(greatest(cst.v - 2, 0) * {r2}::DOUBLE)::INTEGER AS sz,
         row_number() OVER (PARTITION BY p.sample_idx ORDER BY md5(concat_ws(':', '42', p.sample_idx::VARCHAR, '2', p.pos::VARCHAR)), p.pos) AS r,
         count(*) OVER (PARTITION BY p.sample_idx) AS pn
  FROM pool2 p JOIN cst USING (sample_idx)),
d2 AS (SELECT sample_idx, pos, n FROM d2p WHERE sz > 0 AND (r <= sz OR pn < sz)),
pool3 AS (
  SELECT x.sample_idx, x.pos FROM (SELECT sample_idx, (pos + 1) % n AS pos FROM d2) x
  WHERE x.pos <> 0 AND EXISTS (SELECT 1 FROM valid v WHERE v.sample_idx = x.sample_idx AND v.pos = x.pos)),
d3p AS (
  SELECT p.sample_idx, p.pos, cst.n, floor(greatest(cst.v - 3, 0) * {r3}::DOUBLE)::INTEGER AS sz,
         row_number() OVER (PARTITION BY p.sample_idx ORDER BY md5(concat_ws(':', '42', p.sample_idx::VARCHAR, '3', p.pos::VARCHAR)), p.pos) AS r,
         count(*) OVER (PARTITION BY p.sample_idx) AS pn
  FROM pool3 p JOIN cst USING (sample_idx)),
d3 AS (SELECT sample_idx, pos, n FROM d3p WHERE sz > 0 AND (r <= sz OR pn < sz)),
cod AS (
  SELECT sample_idx, pos AS anchor, 0 AS depth FROM stok
  UNION ALL SELECT sample_idx, pos - 1, 1 FROM d1
  UNION ALL SELECT sample_idx, pos - 2, 2 FROM d2
  UNION ALL SELECT sample_idx, pos - 3, 3 FROM d3)""".format(
    r1=max(0.7 ** 1, 0.2), r2=max(0.7 ** 2, 0.2), r3=max(0.7 ** 3, 0.2))


@register("Q22_cod_sample", f"WITH {_S}, {_COD} SELECT sample_idx, anchor::BIGINT AS anchor, depth::BIGINT AS depth FROM cod")
def q22(spark, sf):
    return Q.cod_sample_arrays(D.samples(spark, sf), 4, 0.7, 0.2, SEED)


@register("Q23_cod_inputs", f"""
WITH {_S}, {_COD}
SELECT c.sample_idx, c.anchor::BIGINT AS anchor, c.depth::BIGINT AS depth, (c.anchor + c.depth)::BIGINT AS position,
       CASE WHEN c.depth = 0 THEN t.token ELSE 49999 END::BIGINT AS input_token, coalesce(t.mask, false) AS mask
FROM cod c LEFT JOIN stok t ON t.sample_idx = c.sample_idx AND t.pos = c.anchor + c.depth""")
def q23(spark, sf):
    return Q.cod_sample_arrays(D.samples(spark, sf), 4, 0.7, 0.2, SEED, mask_token_id=49999)
