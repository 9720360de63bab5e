"""Sequence shaping goldens (values follow the reference's unit tests)."""

import pytest
from pyspark.sql import functions as F

from draftkit.functions.arrays import positions
from draftkit.operators import shape as Q


def test_shift_batch(spark):
    df = spark.createDataFrame([([10, 11, 12, 13, 14], [[float(i)] * 3 for i in range(5)],
                                 [[float(i)] for i in range(5)], [0, 1, 1, 1, 0], [5])],
                               "input_ids array<int>, hidden_states array<array<double>>, "
                               "verifier_last_hidden_states array<array<double>>, loss_mask array<int>, lengths array<int>")
    df = df.withColumn("position_ids", positions(F.lit(5)))
    r = Q.next_token_shift(df).first()
    assert r["input_ids"] == [11, 12, 13, 14]
    assert [h[0] for h in r["hidden_states"]] == [0.0, 1.0, 2.0, 3.0]
    assert [h[0] for h in r["verifier_last_hidden_states"]] == [1.0, 2.0, 3.0, 4.0]
    assert r["loss_mask"] == [1, 1, 1, 0] and r["lengths"] == [4] and r["position_ids"] == [1, 2, 3, 4]
    empty = spark.createDataFrame([([], [0])], "input_ids array<int>, lengths array<int>")
    assert Q.next_token_shift(empty).first()["lengths"] == [0]


def test_positions_guard(spark):
    r = spark.range(1).select(positions(F.lit(0)).alias("a"), positions(F.lit(3)).alias("b")).first()
    assert r["a"] == [] and r["b"] == [0, 1, 2]


def test_layer_split(spark):
    rows = [(0, p, layer, [float(layer * 10 + p)] * 3) for p in range(5) for layer in range(4)]
    df = spark.createDataFrame(rows, "sample_idx long, pos long, layer int, vec array<double>")
    r = {x["pos"]: x for x in Q.split_layers_long(df).collect()}
    assert len(r) == 5
    assert len(r[0]["hidden_states"]) == 9 and len(r[0]["verifier_last_hidden_states"]) == 3
    assert r[2]["hidden_states"][:4] == [2.0, 2.0, 2.0, 12.0] and r[2]["verifier_last_hidden_states"] == [32.0] * 3


def test_collate_and_empty_batch(spark):
    m = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3, 4, 5, 6, 7, 8]), (1, 0, None)],
                              "batch_id long, ord int, input_ids array<int>")
    spine = spark.createDataFrame([(0,), (1,)], "batch_id long")
    r = {x["batch_id"]: x for x in Q.collate(m, spine, 10, ["input_ids"]).collect()}
    assert r[0]["raw_lengths"] == [2, 6] and r[0]["input_ids"][:8] == [1, 2, 3, 4, 5, 6, 7, 8] and len(r[0]["input_ids"]) == 10
    assert r[1]["input_ids"] == [0] * 10 and r[1]["raw_lengths"] == []


def test_length_cut(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (0, 2, 3)], "batch_id long, ord int, len int")
    r = [x["kept_len"] for x in Q.kept_lengths(df, 11).orderBy("ord").collect()]
    assert r == [5, 6]


def test_document_ids(spark):
    df = spark.createDataFrame([([2, 3],)], "lengths array<int>")
    assert df.select(Q.document_ids(F.col("lengths"), 7).alias("d")).first()["d"] == [0, 0, 1, 1, 1, -1, -1]
    with pytest.raises(Exception):
        df.select(Q.document_ids(F.col("lengths"), 4).alias("d")).collect()


def test_block_positions(spark):
    a = spark.createDataFrame([(0, 0, 1, True), (0, 1, 4, True)], "sample_idx long, slot int, anchor int, valid boolean")
    r = [x["position"] for x in Q.block_positions(a, 3).orderBy("slot", "offset").collect()]
    assert r == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception):
        Q.block_positions(a, 3, F.lit(6)).collect()


def test_cod_invariants(spark):
    rows = [(s, p, p * 7 % 11, (p % 3) != 0) for s in range(3) for p in range(40)]
    t = spark.createDataFrame(rows, "sample_idx long, pos long, token int, mask boolean")
    c = Q.cod_sample(t, 5, 0.7, 0.2, 1).collect()
    per = {}
    for r in c:
        per.setdefault((r["sample_idx"], r["depth"]), []).append(r["anchor"])
    valid = {(s, p) for s, p, _, m in rows if m}
    for s in range(3):
        assert sorted(per[(s, 0)]) == list(range(40))
        v = sum(1 for (ss, _p) in valid if ss == s)
        for d in range(1, 5):
            got = per.get((s, d), [])
            size = int(max(0, v - d) * max(0.7 ** d, 0.2))
            assert len(got) <= max(size, 0)
            for a in got:  # chosen position = anchor + d is trainable
                assert (s, a + d) in valid


def _fixture(spark):
    rows = [(s, p, (p * 7 + s) % 13, (p + s) % 3 != 0) for s in range(4) for p in range(30 + 5 * s)]
    t = spark.createDataFrame(rows, "sample_idx long, pos long, token int, mask boolean")
    arr = t.groupBy("sample_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "mask"))).alias("_t")).select(
        "sample_idx", F.transform("_t", lambda x: x["token"]).alias("input_ids"),
        F.transform("_t", lambda x: x["mask"]).alias("loss_mask"))
    return t, arr


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_array_forms_equal_long_forms(spark):
    t, arr = _fixture(spark)
    c = ["sample_idx", "pos", "step", "input_token", "target"]
    assert _rows(Q.mtp_steps(t, 3), c) == _rows(Q.mtp_steps_arrays(arr, 3), c)
    c = ["sample_idx", "slot", "anchor", "valid"]
    long_a = Q.select_anchors(t, 5, 4, 9)
    arr_a = Q.anchors_arrays(arr, 5, 4, 9)
    assert _rows(long_a, c) == _rows(arr_a.select("sample_idx", F.inline("anchors")), c)
    c = ["sample_idx", "slot", "offset", "position", "block_mask", "block_input", "target"]
    assert _rows(Q.block_targets(Q.block_positions(long_a, 4), t, 99), c) == _rows(Q.block_targets_arrays(arr_a, 4, 99), c)
    c = ["sample_idx", "anchor", "depth"]
    assert _rows(Q.cod_sample(t, 5, 0.7, 0.2, 3), c) == _rows(Q.cod_sample_arrays(arr, 5, 0.7, 0.2, 3), c)
    c = ["sample_idx", "anchor", "depth", "position", "input_token", "mask"]
    assert _rows(Q.cod_inputs(Q.cod_sample(t, 5, 0.7, 0.2, 3), t, 99), c) == \
        _rows(Q.cod_sample_arrays(arr, 5, 0.7, 0.2, 3, mask_token_id=99), c)


def test_noise_statistics_and_registry(spark):
    import statistics
    df = spark.createDataFrame([(i, [0.0] * 64) for i in range(200)], "vec_id long, v array<double>")
    u = [x for r in df.select(Q.uniform_noise(F.col("v"), 1, F.col("vec_id"), 0.05).alias("n")).collect() for x in r["n"]]
    g = [x for r in df.select(Q.gaussian_noise(F.col("v"), 1, F.col("vec_id"), 0.05).alias("n")).collect() for x in r["n"]]
    assert max(abs(x) for x in u) <= 0.05 and abs(statistics.mean(u)) < 0.003
    assert abs(statistics.mean(g)) < 0.003 and abs(statistics.pstdev(g) - 0.05) < 0.003
    again = [x for r in df.select(Q.gaussian_noise(F.col("v"), 1, F.col("vec_id"), 0.05).alias("n")).collect() for x in r["n"]]
    assert again == g  # replayable
    s = spark.createDataFrame([([1, 2, 3], [1, 1, 1], [3])], "input_ids array<int>, loss_mask array<int>, lengths array<int>")
    assert s.transform(Q.PREPROCESS["next_token"]).first()["input_ids"] == [2, 3]
    assert s.transform(Q.PREPROCESS["parallel"]).first()["input_ids"] == [2, 3]
    assert s.transform(Q.PREPROCESS["block"]).first()["input_ids"] == [1, 2, 3]


def test_pack_shape_matrix(spark):
    """Length x mask-pattern matrix: document ids, collate and cut lengths."""
    import random
    rnd = random.Random(42)
    patterns = {"single": [128], "halves": [64, 64], "uneven": [32, 96], "many": [8] * 20, "empty": []}
    masks = {"all": lambda n: [True] * n, "none": lambda n: [False] * n,
             "alternating": lambda n: [i % 2 == 0 for i in range(n)], "random": lambda n: [rnd.random() < 0.5 for _ in range(n)]}
    rows, lens_rows = [], []
    for b, (pname, lens) in enumerate(patterns.items()):
        for mname, mk in masks.items():
            bid = b * 10 + list(masks).index(mname)
            for o, n in enumerate(lens):
                rows.append((bid, o, list(range(n)), mk(n)))
            lens_rows.append((bid, lens))
    members = spark.createDataFrame(rows, "batch_id long, ord int, input_ids array<int>, loss_mask array<boolean>")
    spine = spark.createDataFrame([(b,) for b, _ in lens_rows], "batch_id long")
    col = {r["batch_id"]: r for r in Q.collate(members, spine, 160, ["input_ids", "loss_mask"], pads={"loss_mask": False}).collect()}
    ids = {r["batch_id"]: r["d"] for r in spark.createDataFrame(lens_rows, "batch_id long, lengths array<int>").select(
        "batch_id", Q.document_ids(F.col("lengths"), 160).alias("d")).collect()}
    for bid, lens in lens_rows:
        want = [i for i, n in enumerate(lens) for _ in range(n)]
        assert ids[bid] == want + [-1] * (160 - len(want))
        assert len(col[bid]["input_ids"]) == 160 and col[bid]["raw_lengths"] == lens
        mask_rows = [r for r in rows if r[0] == bid]
        assert sum(col[bid]["loss_mask"]) == sum(sum(r[3]) for r in mask_rows)


def test_block_position_goldens(spark):
    """Anchored block positions (values from the reference's block tests)."""
    def run(anchors, b, total=None):
        a = spark.createDataFrame([(0, i, x, True) for i, x in enumerate(anchors)],
                                  "sample_idx long, slot int, anchor int, valid boolean")
        return [r["position"] for r in Q.block_positions(a, b, F.lit(total) if total else None).orderBy("slot", "offset").collect()]
    assert run([3], 4) == [3, 4, 5, 6]
    assert run([0, 5, 10], 3) == [0, 1, 2, 5, 6, 7, 10, 11, 12]
    assert run([2, 7, 9], 1) == [2, 7, 9]
    assert run([0, 3], 4, 7) == [0, 1, 2, 3, 3, 4, 5, 6]
    for bad in (([0, 3], 4, 6), ([-1, 3], 2, None)):
        with pytest.raises(Exception, match="out of range"):
            run(*bad)
