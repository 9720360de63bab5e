"""Counter parsing, acceptance, interpolation."""

import numpy as np
from pyspark.sql import functions as F

from draftkit.operators import evals as E


def test_parse_and_rates(spark):
    lines = ["# HELP x", "vllm:spec_decode_num_drafts_total 100", 'vllm:spec_decode_num_drafts_total{engine="1"} 100',
             "vllm:spec_decode_num_accepted_tokens_total 89.26",
             'vllm:spec_decode_num_accepted_tokens_per_pos_total{position="0"} 68.72',
             'vllm:spec_decode_num_accepted_tokens_per_pos_total{position="2"} 2.54',
             'vllm:spec_decode_num_accepted_tokens_per_pos_total{position="1"} 18.0',
             'vllm:spec_decode_num_accepted_tokens_per_pos_total{position="1"} 17.0',
             "vllm:spec_decode_num_drafts_total NaN", "other_metric 5"]
    df = spark.createDataFrame([("a", x) for x in lines], "subset string, value string")
    tot = E.scrape_totals(E.parse_counter_lines(df, ["subset"]), ["subset"])
    scal, pos = E.acceptance_rates(tot, ["subset"])
    s = scal.first()
    assert s["num_drafts"] == 200.0
    assert abs(s["acceptance_length"] - (1 + 89.26 / 200)) < 1e-12
    rates = {r["position"]: r["rate"] for r in pos.collect()}
    assert rates == {0: 68.72 / 200, 1: 18.0 / 200, 2: 2.54 / 200}  # duplicate: largest wins


def test_golden_acceptance_length(spark):
    # published per-position rates imply length = 1 + sum of positions
    df = spark.createDataFrame([("s", E.N_DRAFTS, None, 10000.0), ("s", E.N_ACCEPTED, None, 4563.0),
                                ("s", E.N_PER_POS, 0, 3436.0), ("s", E.N_PER_POS, 1, 900.0), ("s", E.N_PER_POS, 2, 127.0)],
                               "subset string, name string, position int, value double")
    scal, pos = E.acceptance_rates(df, ["subset"])
    assert abs(sum(r["rate"] for r in pos.collect()) + 1 - 1.4463) < 1e-9


def test_subtract_zero_extends(spark):
    a = spark.createDataFrame([("s", "n", 0, 5.0), ("s", "n", 1, 3.0)], "subset string, name string, position int, value double")
    b = spark.createDataFrame([("s", "n", 0, 1.0)], "subset string, name string, position int, value double")
    r = {x["position"]: x["value"] for x in E.subtract_baseline(a, b, ["subset"]).collect()}
    assert r == {0: 4.0, 1: 3.0}


def test_interpolation_matches_numpy(spark):
    bx, by = [1.0, 2.0, 4.0, 8.0], [10.0, 12.0, 20.0, 30.0]
    tx, ty = [1.5, 3.0, 6.0, 9.0], [5.0, 6.0, 9.0, 20.0]
    rows = [("b", "s", x, y) for x, y in zip(bx, by)] + [("t", "s", x, y) for x, y in zip(tx, ty)]
    pts = spark.createDataFrame(rows, "label string, subset string, x double, y double")
    r = E.interpolate_speedup(pts, "b", "t", increasing=True).orderBy("gi").collect()
    grid = np.linspace(1.5, 8.0, 200)
    assert np.allclose([x["x"] for x in r], grid)
    assert np.allclose([x["y_baseline"] for x in r], np.interp(grid, bx, by))
    assert np.allclose([x["speedup"] for x in r], np.interp(grid, bx, by) / np.interp(grid, tx, ty))
    none = spark.createDataFrame([("b", "s", 1.0, 1.0), ("b", "s", 2.0, 1.0), ("t", "s", 3.0, 1.0), ("t", "s", 4.0, 1.0)],
                                 "label string, subset string, x double, y double")
    assert E.interpolate_speedup(none, "b", "t", increasing=False).count() == 0


def test_gate_and_names(spark):
    pos = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.2), ("b", 0, 0.5)], "subset string, position int, rate double")
    r = {x["subset"]: x["passed"] for x in E.acceptance_gate(pos, [0.4, 0.1, 0.01], ["subset"]).collect()}
    assert r == {"a": False, "b": False}
    df = spark.createDataFrame([("/x/gen_len_qa.json",), ("/x/sweeps_rag.json",), ("/x/other.csv",)], "p string")
    assert [r["s"] for r in df.select(E.subset_from_filename(F.col("p")).alias("s")).collect()] == ["qa", "rag", "other"]
    assert spark.createDataFrame([("qa",), ("zz",)], "s string").select(E.pretty_subset(F.col("s")).alias("p")).collect()[0]["p"] == "QA"


def test_no_drafts_variants(spark):
    df = spark.createDataFrame([("s", E.N_DRAFTS, None, 0.0), ("s", E.N_PER_POS, 0, 0.0)],
                               "subset string, name string, position int, value double")
    a, pa = E.acceptance_rates(df, ["subset"])
    b, pb = E.acceptance_rates(df, ["subset"], no_drafts_length=1.0, pos_prefix="acceptance_at_token_")
    assert a.first()["acceptance_length"] == 0.0 and b.first()["acceptance_length"] == 1.0
    assert pb.first()["metric"] == "acceptance_at_token_0" and pb.first()["rate"] == 0.0
    import pytest
    with pytest.raises(Exception, match="no subset produced drafts"):  # the job fails, no action before it
        E.subsets_with_drafts(a).collect()


def test_smooth_curve_is_the_least_squares_cubic(spark):
    rng = np.random.default_rng(5)
    curves = {"many": (rng.uniform(3, 900, 500), None), "few": (np.array([1.0, 2.0, 5.0, 9.0]), None), "same": (np.array([7.0, 7.0, 7.0]), None),
              "two": (np.array([4.0, 2.0]), None), "three": (np.array([1.0, 2.0, 2.0, 8.0]), None), "one": (np.array([3.0]), None),
              "close": (1e6 + rng.uniform(0, 1, 50), None)}
    curves = {k: (x, np.sin(x / 100) * 5 + rng.normal(size=len(x))) for k, (x, _) in curves.items()}
    rows = [("a", k, float(u), float(v)) for k, (x, y) in curves.items() for u, v in zip(x, y)] + [("a", "two", None, 1.0), ("a", "two", 5.0, None)]
    got = {}
    for r in E.smooth_curve(spark.createDataFrame(rows, "label string, subset string, x double, y double")).collect():
        got.setdefault(r.subset, []).append((r.gi, r.x, r.y_smooth))
    for k, (x, y) in curves.items():
        g = np.array(sorted(got[k]))
        grid = np.linspace(x.min(), x.max(), 300) if len(x) > 1 else x
        assert np.allclose(g[:, 1], grid)
        degree = min(3, len(set(x.tolist())) - 1)
        fit = np.polynomial.Polynomial.fit(x - x.min(), y, degree, domain=[0, max(x.max() - x.min(), 1)])
        assert np.allclose(g[:, 2], fit(grid - x.min()), atol=1e-7), k
    assert got["one"] == [(0, 3.0, curves["one"][1][0])]
