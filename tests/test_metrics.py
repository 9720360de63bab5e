"""Metric goldens and laws."""

import math

import numpy as np
from pyspark.sql import functions as F

from draftkit.operators import metrics as M


def test_step_accuracy_chain(spark):
    # two steps over 4 positions, values as in the reference's unit test
    steps = {0: ([1, 2, 3, 0], [1, 2, 3, 4]), 1: ([1, 2, 0, 4], [1, 2, 5, 4])}
    rows = [(0, p, s, pr[p] == tg[p], True) for s, (pr, tg) in steps.items() for p in range(4)]
    df = spark.createDataFrame(rows, "sample_idx long, pos long, step int, correct boolean, mask boolean")
    a = {r["step"]: (r["full_correct"], r["full_total"], r["cond_total"])
         for r in M.step_accuracy(M.chain_steps(df, ["sample_idx", "pos"]), ["step"]).collect()}
    assert a == {0: (3, 4, 4), 1: (2, 4, 3)}


def test_kl_ce_laws(spark):
    rng = np.random.default_rng(0)
    d, t = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    df = spark.createDataFrame([(d, t), (d, d)], "d array<double>, t array<double>")
    r = df.select(M.kl_div(F.col("d"), F.col("t")).alias("kl"), M.cross_entropy(F.col("d"), F.col("t")).alias("ce")).collect()
    p = np.exp(np.array(t) - np.logaddexp.reduce(t))
    ld = np.array(d) - np.logaddexp.reduce(d)
    assert math.isclose(r[0]["kl"], float(np.sum(p * (np.log(p) - ld))), rel_tol=1e-9)
    assert math.isclose(r[0]["ce"], float(-ld[int(np.argmax(t))]), rel_tol=1e-9)
    assert abs(r[1]["kl"]) < 1e-12


def test_decays(spark):
    r = spark.range(4).select(M.decay_block(F.col("id"), 2.0).alias("a"), M.decay_pow(F.col("id"), 0.5).alias("b")).collect()
    assert [x["a"] for x in r] == [0.0, 1.0, math.exp(-0.5), math.exp(-1.0)]
    assert [x["b"] for x in r] == [1.0, 0.5, 0.25, 0.125]


def test_masked_loss_denominator_has_no_decay(spark):
    df = spark.createDataFrame([(0, 0, 2.0, 1.0), (0, 1, 4.0, 1.0), (1, 0, 1.0, 0.0)], "row long, pos long, loss double, mask double")
    r = M.masked_loss(df, ["row"], decay=M.decay_pow(F.col("pos"), 0.5)).first()["loss"]
    assert math.isclose(r, ((2.0 + 2.0) / (2 + 1e-5) + 0.0) / 2)


def test_normalize_counted(spark):
    df = spark.createDataFrame([(0, "loss_sum", 6.0), (0, "loss_total", 3.0), (0, "acc_sum", 1.0), (0, "acc_total", 0.0),
                                (0, "lr", 4.0), (0, "orphan_total", 9.0)], "step long, name string, value double")
    r = {x["name"]: x["value"] for x in M.normalize_counted(df, ["step"], world_size=2).collect()}
    assert r == {"loss": 2.0, "acc": 0.0, "lr": 2.0}


def test_best_and_latest(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.0), (3, 1.5)], "epoch long, loss_epoch double")
    r = M.best_epochs(df).orderBy("epoch").collect()
    assert [x["improved"] for x in r] == [True, True, False, True] and r[0]["best_epoch"] == 3
    names = spark.createDataFrame([("3",), ("12",), ("interrupted",), ("best",)], "name string")
    assert M.latest_checkpoint(names).first()["latest"] == 12
    assert [round(w, 6) for w in M.step_weights(3, 0.6)] == [round(x / 1.96, 6) for x in (1, 0.6, 0.36)]


def test_greedy_acceptance(spark):
    v = spark.createDataFrame([(0, 0, 5, -0.1), (0, 0, 6, -0.2), (0, 1, 7, -0.1), (0, 1, 8, -3.0), (0, 2, 9, -0.1)],
                              "k long, pos long, token long, logprob double")
    p = spark.createDataFrame([(0, 0, 6), (0, 1, 8), (0, 2, 9)], "k long, pos long, token long")
    assert M.greedy_acceptance(p, v, 2, 0.5, ["k"]).first()["accepted_len"] == 1
    assert M.greedy_acceptance(p, v, 1, 0.0, ["k"]).first()["accepted_len"] == 0


def test_block_position_accuracy_goldens(spark):
    """Per-position counts over blocks of 2 (values from the reference's
    block-metrics tests): argmax of logits vs argmax of targets."""
    logits = [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]

    def run(target_ids, mask):
        rows = [(i, logits[i], target_ids[i], bool(mask[i])) for i in range(4)]
        df = spark.createDataFrame(rows, "pos long, logits array<double>, target long, mask boolean")
        d = df.select((F.col("pos") % 2).cast("int").alias("pos_idx"),
                      (M.argmax_id(F.col("logits")) == F.col("target")).alias("correct"), "mask")
        return {r["pos_idx"]: (r["correct"], r["total"]) for r in M.per_position_accuracy(d, 2).collect()}
    assert run([2, 1, 0, 0], [1, 1, 1, 1]) == {0: (2, 2), 1: (1, 2)}
    r = run([2, 0, 0, 1], [1, 0, 1, 1])
    assert r[0][0] / r[0][1] == 1.0 and r[1][0] / r[1][1] == 1.0
    empty = run([2, 1, 0, 0], [0, 0, 0, 0])
    assert sum(c for c, _ in empty.values()) == 0 and sum(t for _, t in empty.values()) == 0


def test_step_losses_and_chain(spark):
    """The literal of the chained step accuracy, with a loss per sample."""
    rows = [(0, pos, [p0 == t0, p1 == t1], [True, True], [1.0, 2.0]) for pos, (p0, t0, p1, t1) in enumerate(
        [(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 0, 5), (0, 4, 4, 4)])] + [(1, 0, [True, True], [False, True], [9.0, 4.0])]
    df = spark.createDataFrame(rows, "row long, pos long, correct array<boolean>, mask array<boolean>, loss array<double>")
    d = df.withColumn("prev", M.chain_in_row(F.col("correct"), F.col("mask"))).withColumn("step", F.array(F.lit(0), F.lit(1)))
    d = d.select("row", F.inline(F.arrays_zip("step", "correct", "mask", "prev", "loss")))
    r = {x["step"]: x for x in M.step_metrics(d, ["row"], 0.5).collect()}
    assert (r[0].full_correct, r[0].full_total, r[0].cond_total) == (3, 4, 4)
    assert (r[1].full_correct, r[1].full_total, r[1].cond_total) == (3, 5, 4)
    assert r[0].loss_total == r[1].loss_total == 2
    assert math.isclose(r[0].loss_sum, 4.0 / (4 + 1e-5) + 0.0)
    assert math.isclose(r[1].loss_sum, 0.5 * (8.0 / (4 + 1e-5) + 4.0 / (1 + 1e-5)))


def test_block_and_depth_losses(spark):
    rows = [(0, 0, True, True, 5.0), (0, 1, True, True, 2.0), (0, 2, False, True, 4.0), (1, 1, True, False, 8.0)]
    df = spark.createDataFrame(rows, "row long, p int, correct boolean, mask boolean, loss double")
    a = {r["p"]: r for r in M.position_metrics(df, ["row"], 4, "p", M.decay_block(F.col("p"), 2.0)).collect()}
    assert [(a[k].correct, a[k].total) for k in range(4)] == [(1, 1), (1, 1), (0, 1), (0, 0)]
    assert all(math.isclose(a[k].loss_sum, (2.0 + 4.0 * math.exp(-0.5)) / (3 + 1e-5)) and a[k].loss_total == 2 for k in a)
    b = M.position_metrics(df, ["row"], 3, "p").first()
    assert math.isclose(b.loss_sum, 11.0 / (3 + 1e-5))
