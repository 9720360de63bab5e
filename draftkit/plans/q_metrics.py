"""Queries for draft-quality metrics and training-log analytics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.operators import metrics as M
from draftkit.operators import shape as Q
from draftkit.plans import derived as D
from draftkit.plans.catalog import round6, register, table
from draftkit.plans.q_shape import _COD
from draftkit.plans.sqlgen import argmax_sql, logit_pairs_cte, lse, metric_log_cte, predictions_ctes, round6_sql, sample_tokens_ctes

SEED = 42
_S = sample_tokens_ctes(D.SAMPLE_MAXLEN, D.HASH_VOCAB)
_P = _S + predictions_ctes(SEED, 3)


def r6(c):
    return round6(c)


@register("M1_argmax", f"SELECT vec_id, {argmax_sql('embedding')}::BIGINT AS argmax FROM embeddings")
def m1(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", M.argmax_id(F.col("embedding")).alias("argmax"))


_LOGIT = f"""
WITH {logit_pairs_cte(1)},
l AS (SELECT *, {lse('draft')} AS ld, {lse('target')} AS lt FROM pairs)"""


@register("M5_kl_div", _LOGIT + """
SELECT vec_id, (floor((list_sum(list_transform(generate_series(1, len(target)),
       lambda i: exp(target[i] - lt) * ((target[i] - lt) - (draft[i] - ld))))) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS kl FROM l""")
def m5(spark, sf):
    p = D.logit_pairs(spark, sf)
    return p.select("vec_id", r6(M.kl_div(F.col("draft"), F.col("target"))).alias("kl"))


@register("M6_cross_entropy", _LOGIT + f"""
SELECT vec_id, (floor((ld - draft[{argmax_sql('target')} + 1]) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS ce FROM l""")
def m6(spark, sf):
    p = D.logit_pairs(spark, sf)
    return p.select("vec_id", r6(M.cross_entropy(F.col("draft"), F.col("target"))).alias("ce"))


@register("M9_masked_loss_decay", _LOGIT + f""",
x AS (SELECT label, vec_id % 4 AS pos_idx, ld - draft[{argmax_sql('target')} + 1] AS loss,
             CASE WHEN draft[1] > 0 THEN 1.0 ELSE 0.0 END AS m FROM l),
y AS (SELECT *, CASE WHEN pos_idx = 0 THEN 0.0 ELSE exp(-greatest(pos_idx - 1, 0) / 7.0) END AS dA,
             pow(0.8, pos_idx) AS dB FROM x),
r AS (SELECT label, sum(loss * m) / (sum(m) + 1e-5) AS l0, sum(loss * m * dA) / (sum(m) + 1e-5) AS la,
             sum(loss * m * dB) / (sum(m) + 1e-5) AS lb FROM y GROUP BY label)
SELECT (floor((avg(l0)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS loss_plain, (floor((avg(la)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS loss_block_decay, (floor((avg(lb)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS loss_pow_decay FROM r""")
def m9(spark, sf):
    p = D.logit_pairs(spark, sf)
    d = p.select("label", (F.col("vec_id") % 4).alias("pos_idx"),
                 M.cross_entropy(F.col("draft"), F.col("target")).alias("loss"),
                 (F.element_at("draft", 1) > 0).alias("mask"))
    out = M.masked_loss(d, ["label"], decays={
        "loss_plain": None, "loss_block_decay": M.decay_block(F.col("pos_idx"), 7.0),
        "loss_pow_decay": M.decay_pow(F.col("pos_idx"), 0.8)})
    return out.select(*[r6(F.col(x)).alias(x) for x in ("loss_plain", "loss_block_decay", "loss_pow_decay")])


@register("M11_step_accuracy_chain", f"""
WITH {_P},
c AS (SELECT *, pred = target AS correct FROM preds),
p AS (SELECT *, mask AND coalesce(min(correct::INTEGER) OVER (PARTITION BY sample_idx, pos ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, true) AS prev FROM c),
s AS (SELECT sample_idx, step, count(*) FILTER (WHERE correct AND prev AND mask) AS c, count(*) FILTER (WHERE mask) AS t,
             count(*) FILTER (WHERE prev) AS p, sum(loss * mask::INTEGER * pow(0.8, step)) / (sum(mask::INTEGER) + 1e-5) AS l
      FROM p GROUP BY sample_idx, step)
SELECT step::BIGINT AS step, sum(c)::BIGINT AS full_correct, sum(t)::BIGINT AS full_total, sum(p)::BIGINT AS cond_total,
       {round6_sql('sum(c) / sum(t)')} AS full_acc, {round6_sql('sum(c) / sum(p)')} AS cond_acc,
       {round6_sql('sum(l)')} AS loss_sum, count(*)::BIGINT AS loss_total
FROM s GROUP BY step""")
def m11(spark, sf):
    p = D.prediction_steps(spark, sf)
    p = p.withColumn("correct", F.transform("s", lambda x: x["pred"] == x["target"]))
    p = p.withColumn("prev", M.chain_in_row(F.col("correct"), F.col("s.mask")))
    steps = F.zip_with(F.arrays_zip("s", "prev"), "correct", lambda z, c: F.struct(
        M.kl_div(*D.draw_logits(z["s"]["draw"])).alias("loss"), c.alias("correct"), z["s"]["mask"].alias("mask"), z["prev"].alias("prev")))
    a = M.step_metrics_rows(p.select("sample_idx", steps.alias("s")), ["sample_idx"], 3, 0.8)
    return a.select("step", "full_correct", "full_total", "cond_total",
                    r6(F.col("full_correct") / F.col("full_total")).alias("full_acc"),
                    r6(F.col("full_correct") / F.col("cond_total")).alias("cond_acc"),
                    r6(F.col("loss_sum")).alias("loss_sum"), "loss_total")


@register("M4_M10_block_accuracy", f"""
WITH {_P},
b AS (SELECT sample_idx, pos % 4 AS pos_idx, pred = target AS correct, mask, loss FROM preds WHERE step = 0),
a AS (SELECT pos_idx, count(*) FILTER (WHERE correct) AS c, count(*) AS t FROM b WHERE mask GROUP BY pos_idx),
l AS (SELECT sum(loss * mask::INTEGER * CASE WHEN pos_idx = 0 THEN 0.0 ELSE exp(-(pos_idx - 1) / 4.0) END)
             / (sum(mask::INTEGER) + 1e-5) AS l FROM b GROUP BY sample_idx),
sp AS (SELECT unnest(generate_series(0, 3)) AS pos_idx)
SELECT sp.pos_idx::BIGINT AS pos_idx, coalesce(a.c, 0)::BIGINT AS correct, coalesce(a.t, 0)::BIGINT AS total,
       sp.pos_idx <> 0 AS counted, {round6_sql('(SELECT sum(l) FROM l)')} AS loss_sum, (SELECT count(*) FROM l)::BIGINT AS loss_total
FROM sp LEFT JOIN a USING (pos_idx)""")
def m4(spark, sf):
    p = D.predictions(spark, sf).filter(F.col("step") == 0)
    b = p.select("sample_idx", (F.col("pos") % 4).cast("int").alias("pos_idx"), (F.col("pred") == F.col("target")).alias("correct"), "mask",
                 M.kl_div(*D.draw_logits(F.col("draw"))).alias("loss"))
    a = M.position_metrics(b, ["sample_idx"], 4, "pos_idx", M.decay_block(F.col("pos_idx"), 4.0))
    return a.select("pos_idx", "correct", "total", (F.col("pos_idx") != 0).alias("counted"), r6(F.col("loss_sum")).alias("loss_sum"), "loss_total")


@register("M12_depth_accuracy", f"""
WITH {_P}, {_COD},
pz AS (SELECT sample_idx, pos, pred = target AS correct, mask, loss FROM preds WHERE step = 0),
j AS (SELECT c.sample_idx, c.depth, z.correct, z.mask, z.loss FROM cod c JOIN pz z ON z.sample_idx = c.sample_idx AND z.pos = c.anchor + c.depth),
l AS (SELECT sum(loss * mask::INTEGER) / (sum(mask::INTEGER) + 1e-5) AS l FROM j GROUP BY sample_idx),
sp AS (SELECT unnest(generate_series(0, 3)) AS depth)
SELECT sp.depth::BIGINT AS depth, count(*) FILTER (WHERE mask AND correct)::BIGINT AS correct,
       count(*) FILTER (WHERE mask)::BIGINT AS total,
       {round6_sql('(SELECT sum(l) FROM l)')} AS loss_sum, (SELECT count(*) FROM l)::BIGINT AS loss_total
FROM sp LEFT JOIN j USING (depth) GROUP BY sp.depth""")
def m12(spark, sf):
    cod = Q.cod_sample_arrays(D.samples(spark, sf), 4, 0.7, 0.2, SEED).withColumn("pos", F.col("anchor") + F.col("depth"))
    p = D.predictions(spark, sf).filter(F.col("step") == 0).select(
        "sample_idx", "pos", (F.col("pred") == F.col("target")).alias("correct"), "mask", M.kl_div(*D.draw_logits(F.col("draw"))).alias("loss"))
    a = M.position_metrics(cod.join(p, ["sample_idx", "pos"]), ["sample_idx"], 4, "depth")
    return a.select("depth", "correct", "total", r6(F.col("loss_sum")).alias("loss_sum"), "loss_total")


@register("M13_M14_mtp_loss", f"""
WITH {logit_pairs_cte(1)}, p2 AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS draft,
       list_transform(b.embedding, lambda x: x::DOUBLE) AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2),
p3 AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS draft,
       list_transform(b.embedding, lambda x: x::DOUBLE) AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3),
u AS (SELECT 0 AS step, * FROM (SELECT vec_id, draft, target FROM pairs) UNION ALL SELECT 1, * FROM p2 UNION ALL SELECT 2, * FROM p3),
ce AS (SELECT step, {lse('draft')} - draft[{argmax_sql('target')} + 1] AS ce FROM u),
per AS (SELECT step, sum(ce) / greatest(count(ce), 1) AS sl FROM ce GROUP BY step)
SELECT (floor((sum(sl * pow(0.6, step) / (1 + 0.6 + 0.36))) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS loss FROM per""")
def m13(spark, sf):
    steps = D.lagged_logits(spark, sf, 3).select("step", M.cross_entropy(F.col("draft"), F.col("target")).alias("ce"))
    w = M.step_weight_table(spark, 3, 0.6)
    return M.mtp_loss(steps, w).select(r6(F.col("loss")).alias("loss"))


_MLOG = f"WITH {metric_log_cte()}"


@register("M16_counted_metrics", _MLOG + """,
e AS (SELECT epoch, name, sum(value) AS value FROM mlog GROUP BY epoch, name),
k AS (SELECT *, regexp_extract(name, '^(.*)_(sum|total)$', 1) AS base, regexp_extract(name, '^(.*)_(sum|total)$', 2) AS kind FROM e),
paired AS (
  SELECT s.epoch, s.base AS name, CASE WHEN t.value > 0 THEN s.value / t.value ELSE 0.0 END AS value
  FROM k s JOIN k t ON t.epoch = s.epoch AND t.base = s.base AND t.kind = 'total' WHERE s.kind = 'sum'),
plain AS (SELECT epoch, name, value / 2.0 AS value FROM k WHERE kind = '')
SELECT epoch::BIGINT AS epoch, name, (floor((value) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS value FROM (SELECT * FROM paired UNION ALL SELECT * FROM plain)""")
def m16(spark, sf):
    log = D.metric_log(spark, sf).groupBy("epoch", "name").agg(F.sum("value").alias("value"))
    out = M.normalize_counted(log, ["epoch"], world_size=2)
    return out.select("epoch", "name", r6(F.col("value")).alias("value"))


_M17 = _MLOG + """,
nb AS (SELECT epoch, count(DISTINCT batch) AS nb FROM mlog GROUP BY epoch),
e AS (SELECT m.epoch, m.name, sum(m.value) / any_value(nb.nb) AS value FROM mlog m JOIN nb USING (epoch) GROUP BY m.epoch, m.name),
k AS (SELECT *, regexp_extract(name, '^(.*)_(sum|total)$', 1) AS base, regexp_extract(name, '^(.*)_(sum|total)$', 2) AS kind FROM e),
paired AS (
  SELECT s.epoch, s.base AS name, CASE WHEN t.value > 0 THEN s.value / t.value ELSE 0.0 END AS value
  FROM k s JOIN k t ON t.epoch = s.epoch AND t.base = s.base AND t.kind = 'total' WHERE s.kind = 'sum'),
plain AS (SELECT epoch, name, value AS value FROM k WHERE kind = ''),
ve AS (SELECT epoch, name || '_epoch' AS name, value FROM (SELECT * FROM paired UNION ALL SELECT * FROM plain))"""


@register("M17_validation_epoch", _M17 + "\nSELECT epoch::BIGINT AS epoch, name, (floor((value) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS value FROM ve")
def m17(spark, sf):
    out = M.validation_epoch(D.metric_log(spark, sf), world_size=1)
    return out.select("epoch", "name", r6(F.col("value")).alias("value"))


@register("M18_log_every", _MLOG + """
SELECT epoch::BIGINT AS epoch, batch::BIGINT AS batch, name, (floor((value) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS value
FROM mlog WHERE (epoch * 24 + batch) % 5 = 0""")
def m18(spark, sf):
    d = D.metric_log(spark, sf).withColumn("step", F.col("epoch") * 24 + F.col("batch"))
    return M.log_every(d, 5).select("epoch", "batch", "name", r6(F.col("value")).alias("value"))


@register("M19_best_epochs", _M17 + """,
l AS (SELECT epoch, value AS loss_epoch FROM ve WHERE name = 'purchase_epoch'),
p AS (SELECT *, min(loss_epoch) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM l)
SELECT epoch::BIGINT AS epoch, (floor((loss_epoch) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS loss_epoch, (pm IS NULL OR loss_epoch < pm) AS improved,
       (SELECT epoch FROM l ORDER BY loss_epoch, epoch LIMIT 1)::BIGINT AS best_epoch
FROM p""")
def m19(spark, sf):
    ve = M.validation_epoch(D.metric_log(spark, sf), world_size=1)
    l = ve.filter(F.col("name") == "purchase_epoch").select("epoch", F.col("value").alias("loss_epoch"))
    b = M.best_epochs(l)
    return b.select("epoch", r6(F.col("loss_epoch")).alias("loss_epoch"), "improved", "best_epoch")


@register("M20_latest_checkpoint", """
WITH n AS (SELECT user_id::VARCHAR AS name FROM events UNION ALL SELECT event_type FROM events
           UNION ALL SELECT 'interrupted')
SELECT max(CASE WHEN regexp_matches(name, '^[0-9]+$') THEN name::BIGINT END) AS latest FROM n""")
def m20(spark, sf):
    ev = table(spark, sf, "events")
    names = (ev.select(F.col("user_id").cast("string").alias("name"))
               .unionByName(ev.select(F.col("event_type").alias("name")))
               .unionByName(spark.createDataFrame([("interrupted",)], "name string")))
    return M.latest_checkpoint(names)


@register("M21_greedy_acceptance", f"""
WITH {logit_pairs_cte(1)},
vt AS (
  SELECT vec_id // 10 AS k, vec_id % 10 AS pos, unnest(generate_series(0, len(draft) - 1)) AS token,
         unnest(draft) AS logprob FROM pairs),
vr AS (SELECT *, row_number() OVER (PARTITION BY k, pos ORDER BY logprob DESC, token) AS rk,
              max(logprob) OVER (PARTITION BY k, pos) AS top FROM vt),
pr AS (SELECT vec_id // 10 AS k, vec_id % 10 AS pos, {argmax_sql('target')} AS token FROM pairs),
j AS (SELECT pr.k, pr.pos, coalesce(vr.logprob IS NOT NULL AND vr.top - vr.logprob <= 0.05, false) AS ok
      FROM pr LEFT JOIN vr ON vr.k = pr.k AND vr.pos = pr.pos AND vr.token = pr.token AND vr.rk <= 3),
s AS (SELECT k, count(*) AS n, min(pos) AS p0, min(pos) FILTER (WHERE NOT ok) AS fr FROM j GROUP BY k)
SELECT k, coalesce(fr - p0, n)::BIGINT AS accepted_len FROM s""")
def m21(spark, sf):
    p = D.logit_pairs(spark, sf)
    key = (F.col("vec_id") / 10).cast("bigint").alias("k")
    pos = (F.col("vec_id") % 10).alias("pos")
    vt = p.select(key, pos, F.posexplode("draft").alias("token", "logprob")).withColumn(
        "logprob", F.col("logprob").cast("double"))
    prop = p.select(key, pos, M.argmax_id(F.col("target")).alias("token"))
    return M.greedy_acceptance(prop, vt, 3, 0.05, ["k"])
