"""Draft-quality metrics and training-log analytics.

Logit math runs on ``array<float>`` columns with ``aggregate``/``zip_with``
(the maximum is subtracted before ``exp``).  Accuracy work is long form:
one row per (sample, position, step) and conditional counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftkit.functions.arrays import argmax, logsumexp

EPS = 1e-5


# ------------------------------------------------------------------ M1 / M5 / M6
def argmax_id(logits: Column) -> Column:
    """M1: first index of the maximum."""
    return argmax(logits)


def _kl_step(acc, z):
    t, d = z["t"], z["d"]
    mt = F.greatest(acc["mt"], t)
    md = F.greatest(acc["md"], d)
    scale = F.exp(acc["mt"] - mt)
    e = F.exp(t - mt)
    return F.struct(mt.alias("mt"), (acc["st"] * scale + e).alias("st"),
                    (acc["w"] * scale + e * (t - d)).alias("w"),
                    md.alias("md"), (acc["sd"] * F.exp(acc["md"] - md) + F.exp(d - md)).alias("sd"))


def kl_div(draft: Column, target: Column) -> Column:
    """M5: ``KL(softmax(target) || softmax(draft))`` for one position.

    ``KL = sum p_i (t_i - d_i) - lse(t) + lse(d)`` with ``p = softmax(t)``;
    one pass over both arrays keeps running maxima and rescaled sums
    (online softmax), so each element is read once."""
    z = F.zip_with(target, draft, lambda t, d: F.struct(t.cast("double").alias("t"), d.cast("double").alias("d")))
    inf = F.lit(float("-inf"))
    init = F.struct(inf.alias("mt"), F.lit(0.0).alias("st"), F.lit(0.0).alias("w"),
                    inf.alias("md"), F.lit(0.0).alias("sd"))
    return F.aggregate(z, init, _kl_step, lambda a: a["w"] / a["st"] - (a["mt"] + F.log(a["st"])) + (a["md"] + F.log(a["sd"])))


def cross_entropy(draft: Column, target: Column) -> Column:
    """M6: CE of the draft logits against ``argmax(target)``."""
    idx = argmax(target)
    return logsumexp(draft) - F.element_at(draft, idx + 1).cast("double")


def cross_entropy_ids(draft: Column, target_id: Column, ignore_index: int = -100) -> Column:
    """M6 with explicit ids; ``ignore_index`` positions give NULL."""
    return F.when(target_id != ignore_index, logsumexp(draft) - F.element_at(draft, target_id + 1).cast("double"))


LOSSES = {"kl_div": kl_div, "ce": cross_entropy}


def loss_by_name(name: str):
    """``kl_div`` or ``ce``; anything else raises."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; choose from {sorted(LOSSES)}")
    return LOSSES[name]


# ------------------------------------------------------------------ M7 / M8
def decay_block(pos: Column, gamma: float) -> Column:
    """M7: 0 at position 0, else ``exp(-(pos - 1) / gamma)``."""
    return F.when(pos == 0, F.lit(0.0)).otherwise(F.exp(-(F.greatest(pos - 1, F.lit(0))).cast("double") / F.lit(gamma)))


def decay_pow(pos: Column, gamma: float) -> Column:
    """M8: ``gamma ** pos``."""
    return F.pow(F.lit(gamma), pos.cast("double"))


# ------------------------------------------------------------------ M2 - M4
def step_accuracy(df: DataFrame, by: list[str] | None = None, correct_col: str = "correct",
                  mask_col: str = "mask", prev_col: str | None = "prev") -> DataFrame:
    """M2: counts of one step.  ``correct`` already includes ``prev`` when
    chained; ``full = correct / masked``, ``cond = correct / prev`` (prev
    counted over all positions; without prev, over all positions)."""
    corr = F.col(correct_col) & F.col(prev_col) if prev_col else F.col(correct_col)
    cond_total = F.count_if(F.col(prev_col)) if prev_col else F.count(F.lit(1))
    g = df.groupBy(*(by or []))
    return g.agg(F.count_if(corr & F.col(mask_col)).cast("bigint").alias("full_correct"),
                 F.count_if(F.col(mask_col)).cast("bigint").alias("full_total"),
                 cond_total.cast("bigint").alias("cond_total"))


def chain_steps(df: DataFrame, key_cols: list[str], step_col: str = "step", correct_col: str = "correct",
                mask_col: str = "mask") -> DataFrame:
    """M3: ``prev`` at step k = mask AND correct at every earlier step of the
    same position (running AND = running min over steps; window bounded by
    the step count)."""
    w = Window.partitionBy(*key_cols).orderBy(step_col).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.min(F.col(correct_col).cast("int")).over(w)
    return df.withColumn("prev", F.col(mask_col) & F.coalesce(earlier == 1, F.lit(True)))


def chain_in_row(correct: Column, mask: Column) -> Column:
    """M3 where a position's steps are arrays of its row: ``prev`` per step
    (no window, no shuffle)."""
    return F.transform(mask, lambda m, k: m & F.forall(F.slice(correct, 1, k), lambda c: c))


def per_position_accuracy(df: DataFrame, num_pos: int, pos_col: str = "pos_idx", correct_col: str = "correct",
                          mask_col: str = "mask", by: list[str] | None = None) -> DataFrame:
    """M4: correct and total per block position over masked-in rows; every
    position ``0..num_pos-1`` appears (zeros when unseen)."""
    by = by or []
    m = df.filter(F.col(mask_col))
    agg = m.groupBy(*by, pos_col).agg(F.count_if(correct_col).cast("bigint").alias("correct"),
                                      F.count(F.lit(1)).cast("bigint").alias("total"))
    spark = df.sparkSession
    spine = spark.range(num_pos).select(F.col("id").cast("int").alias(pos_col))
    if by:
        spine = df.select(*by).distinct().withColumn(pos_col, F.explode(F.sequence(F.lit(0), F.lit(num_pos - 1))))
    return (spine.join(agg, [*by, pos_col], "left")
                 .select(*by, pos_col, F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"),
                         F.coalesce("total", F.lit(0)).cast("bigint").alias("total")))


# ------------------------------------------------------------------ M9 - M14
def masked_loss(df: DataFrame, row_key: list[str], loss_col: str = "loss", mask_col: str = "mask",
                decay: Column | None = None, decays: dict | None = None) -> DataFrame:
    """M9: per row ``sum(loss * mask * decay) / (sum(mask) + 1e-5)`` (the
    denominator has no decay), then the mean over rows.  Two-level
    aggregate: partial sums per row key, then one global average.  With
    ``decays`` ({name: Column}) every variant is computed in the same pass,
    one output column per name; otherwise the column is ``loss``."""
    variants = decays if decays is not None else {"loss": decay}
    w = F.col(mask_col).cast("double")
    l = F.col(loss_col).cast("double")
    sums = [F.sum(l * w * (d if d is not None else F.lit(1.0))).alias(f"_n_{name}") for name, d in variants.items()]
    per_row = df.groupBy(*row_key).agg(F.sum(w).alias("_w"), *sums)
    return per_row.agg(*[F.avg(F.col(f"_n_{name}") / (F.col("_w") + F.lit(EPS))).alias(name) for name in variants])


def _row_loss(loss: str, weight: str) -> list[Column]:
    """Sum over rows of each row's ``loss / (weight + 1e-5)``, and the number
    of rows (a batch counts one per row)."""
    return [F.sum(F.col(loss) / (F.col(weight) + F.lit(EPS))).alias("loss_sum"), F.count(F.lit(1)).alias("loss_total")]


def step_metrics(df: DataFrame, row_key: list[str], gamma: float, loss_col: str = "loss", step_col: str = "step",
                 correct_col: str = "correct", mask_col: str = "mask", prev_col: str = "prev") -> DataFrame:
    """Per step the accuracy counts of M2 and the masked loss of M9 with
    the step's weight ``gamma ** step``: ``loss_sum`` over rows (samples) and
    ``loss_total`` rows."""
    w, hit = F.col(mask_col).cast("double"), F.col(correct_col) & F.col(prev_col)
    per = df.groupBy(*row_key, step_col).agg(
        F.count_if(hit & F.col(mask_col)).alias("_c"), F.count_if(mask_col).alias("_t"), F.count_if(prev_col).alias("_p"),
        F.sum(F.col(loss_col) * w * decay_pow(F.col(step_col), gamma)).alias("_l"), F.sum(w).alias("_w"))
    return per.groupBy(step_col).agg(F.sum("_c").alias("full_correct"), F.sum("_t").alias("full_total"),
                                     F.sum("_p").alias("cond_total"), *_row_loss("_l", "_w"))


def step_metrics_rows(df: DataFrame, row_key: list[str], num_steps: int, gamma: float, steps_col: str = "s") -> DataFrame:
    """M11 where a position's steps lie in its row: ``steps_col`` is an array
    of ``(loss, correct, mask, prev)`` from step 0 on, shorter at a sample's
    end.  All steps of a sample are summed in one grouping of its positions
    (no row per step before it); only a row per sample and step meets the
    last, small one."""
    sums = []
    for k in range(num_steps):
        x = F.get(F.col(steps_col), F.lit(k))
        w = x["mask"].cast("double")
        sums.append(F.struct(
            F.lit(k).alias("step"), F.count(x).alias("rows"), F.count_if(x["correct"] & x["prev"] & x["mask"]).alias("c"), F.count_if(x["mask"]).alias("t"),
            F.count_if(x["prev"]).alias("p"), F.sum(x["loss"] * w * F.lit(gamma ** k)).alias("_l"), F.sum(w).alias("_w")))
    per = df.groupBy(*row_key).agg(F.array(*sums).alias("_k")).select(F.inline("_k")).filter(F.col("rows") > 0)
    return per.groupBy("step").agg(F.sum("c").alias("full_correct"), F.sum("t").alias("full_total"), F.sum("p").alias("cond_total"), *_row_loss("_l", "_w"))


def position_metrics(df: DataFrame, row_key: list[str], num_pos: int, pos_col: str, decay: Column | None = None,
                     loss_col: str = "loss", correct_col: str = "correct", mask_col: str = "mask") -> DataFrame:
    """Per position of a block (or per depth) the masked-in
    correct and total counts, beside the loss over all positions (``loss_sum``
    over rows, ``loss_total`` rows).  M10 weighs positions with
    ``decay_block``, M12 not at all.  Every position has a row."""
    w = F.col(mask_col).cast("double")
    per = df.groupBy(*row_key, pos_col).agg(
        F.count_if(F.col(correct_col) & F.col(mask_col)).alias("_c"), F.count_if(mask_col).alias("_t"),
        F.sum(F.col(loss_col) * w * (decay if decay is not None else F.lit(1.0))).alias("_l"), F.sum(w).alias("_w"))
    rows = per.groupBy(*row_key).agg(F.sum("_l").alias("_l"), F.sum("_w").alias("_w"))
    loss = rows.agg(*_row_loss("_l", "_w"))
    acc = per.groupBy(pos_col).agg(F.sum("_c").alias("correct"), F.sum("_t").alias("total"))
    spine = df.sparkSession.range(num_pos).select(F.col("id").cast("int").alias(pos_col))
    out = spine.join(acc, pos_col, "left").crossJoin(F.broadcast(loss))  # num_pos rows beside one
    return out.select(pos_col, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("correct", "total")],
                      F.coalesce("loss_sum", F.lit(0.0)).alias("loss_sum"), "loss_total")


def step_weights(num_steps: int, beta: float = 0.6) -> list[float]:
    """``beta^k / sum_j beta^j``."""
    raw = [beta ** k for k in range(num_steps)]
    s = sum(raw)
    return [r / s for r in raw]


def step_weight_table(spark, num_steps: int, beta: float = 0.6) -> DataFrame:
    """M14 as a table ``(step, weight)`` (computed by Spark over ``range``)."""
    total = sum(beta ** k for k in range(num_steps))  # closed form, no global window
    d = spark.range(num_steps).select(F.col("id").cast("int").alias("step"))
    return d.withColumn("weight", F.pow(F.lit(beta), F.col("step").cast("double")) / F.lit(total))


def mtp_loss(steps: DataFrame, weights: DataFrame, ce_col: str = "ce", step_col: str = "step") -> DataFrame:
    """Per step the mean CE over valid rows (``sum / max(valid, 1)``),
    then the weighted sum over steps."""
    per = steps.groupBy(step_col).agg(
        (F.sum(F.coalesce(F.col(ce_col), F.lit(0.0))) / F.greatest(F.count(F.col(ce_col)), F.lit(1))).alias("step_loss"))
    return per.join(F.broadcast(weights), step_col).agg(F.sum(F.col("step_loss") * F.col("weight")).alias("loss"))


# ------------------------------------------------------------------ M16 - M20
def normalize_counted(df: DataFrame, key_cols: list[str], world_size: int = 1,
                      name_col: str = "name", value_col: str = "value") -> DataFrame:
    """Long metric table -> ``x_sum / x_total`` as ``x`` (0 when the
    total is not positive); ``_total`` without a ``_sum`` is dropped;
    unpaired metrics are divided by the world size."""
    d = df.withColumn("_base", F.regexp_extract(name_col, r"^(.*)_(sum|total)$", 1)).withColumn(
        "_kind", F.regexp_extract(name_col, r"^(.*)_(sum|total)$", 2))
    sums = d.filter(F.col("_kind") == "sum").select(*key_cols, "_base", F.col(value_col).alias("_s"))
    tots = d.filter(F.col("_kind") == "total").select(*key_cols, "_base", F.col(value_col).alias("_t"))
    paired = sums.join(tots, [*key_cols, "_base"]).select(
        *key_cols, F.col("_base").alias(name_col),
        F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(F.lit(0.0)).alias(value_col))
    paired_keys = paired.select(*key_cols, F.col(name_col).alias("_base")).withColumn("_p", F.lit(True))
    # a _sum whose _total is missing stays as a plain metric
    lone_sums = d.filter(F.col("_kind") == "sum").join(paired_keys, [*key_cols, "_base"], "left_anti")
    plain = d.filter(F.col("_kind") == "").unionByName(lone_sums).select(
        *key_cols, name_col, (F.col(value_col) / F.lit(float(world_size))).alias(value_col))
    return paired.unionByName(plain)


def validation_epoch(batches: DataFrame, world_size: int = 1, epoch_col: str = "epoch") -> DataFrame:
    """Per epoch and metric the sum over batches divided by the number
    of batches, then M16, names suffixed ``_epoch``."""
    nb = batches.groupBy(epoch_col).agg(F.countDistinct("batch").alias("_nb"))
    s = batches.groupBy(epoch_col, "name").agg(F.sum("value").alias("value"))
    avg = s.join(nb, epoch_col).select(epoch_col, "name", (F.col("value") / F.col("_nb")).alias("value"))
    out = normalize_counted(avg, [epoch_col], world_size)
    return out.withColumn("name", F.concat(F.col("name"), F.lit("_epoch")))


def log_every(df: DataFrame, freq: int, step_col: str = "step") -> DataFrame:
    """Keep logging steps (``step % freq == 0``)."""
    return df.filter(F.col(step_col) % freq == 0)


def best_epochs(df: DataFrame, key_cols: list[str] | None = None, epoch_col: str = "epoch",
                loss_col: str = "loss_epoch") -> DataFrame:
    """Epochs that strictly improve on every earlier loss (ties keep the
    earlier epoch) and the final best.  Windows run over epochs of one run
    (a handful of rows)."""
    drop_run = not key_cols
    if drop_run:
        df, key_cols = df.withColumn("_run", F.lit(0)), ["_run"]
    w = Window.partitionBy(*key_cols).orderBy(epoch_col).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_prev_min", F.min(loss_col).over(w))
    d = d.withColumn("improved", F.col("_prev_min").isNull() | (F.col(loss_col) < F.col("_prev_min")))
    best = df.groupBy(*key_cols).agg(F.min_by(epoch_col, F.struct(loss_col, epoch_col)).alias("best_epoch"))
    out = d.drop("_prev_min").join(best, key_cols, "left")
    return out.drop("_run") if drop_run else out


def latest_checkpoint(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Largest integer directory name; non-numeric names (such as
    ``interrupted``) are ignored."""
    n = F.when(F.col(name_col).rlike(r"^[0-9]+$"), F.col(name_col).cast("bigint"))
    return names.agg(F.max(n).alias("latest"))


# ------------------------------------------------------------------ M21
def greedy_acceptance(proposals: DataFrame, verifier_topk: DataFrame, accept_k: int, tolerance: float,
                      key_cols: list[str], pos_col: str = "pos") -> DataFrame:
    """A proposed token is accepted when it is among the verifier's top
    ``accept_k`` at its position and its log-likelihood is within
    ``tolerance`` of the verifier's top-1; the accepted length of a proposal
    is the run of leading accepts.

    ``proposals``: ``(key..., pos, token)``; ``verifier_topk``:
    ``(key..., pos, token, logprob)``.
    """
    w = Window.partitionBy(*key_cols, pos_col).orderBy(F.col("logprob").desc(), "token")
    v = (verifier_topk.withColumn("_rank", F.row_number().over(w))
                      .withColumn("_top", F.max("logprob").over(Window.partitionBy(*key_cols, pos_col))))
    v = v.filter(F.col("_rank") <= accept_k)
    j = proposals.join(v.select(*key_cols, pos_col, "token", "logprob", "_top"), [*key_cols, pos_col, "token"], "left")
    ok = F.col("logprob").isNotNull() & (F.col("_top") - F.col("logprob") <= F.lit(tolerance))
    d = j.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    first_reject = d.filter(~F.col("accepted")).groupBy(*key_cols).agg(F.min(pos_col).alias("_fr"))
    n = d.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"), F.min(pos_col).alias("_p0"))
    res = n.join(first_reject, key_cols, "left")
    return res.select(*key_cols, F.coalesce(F.col("_fr") - F.col("_p0"), F.col("_n")).cast("bigint").alias("accepted_len"))

