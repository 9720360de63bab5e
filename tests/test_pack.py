"""Packing: the plan equals a brute-force packer, for any input layout."""

import random

import pytest

from draftkit.operators import pack as PK


def brute(lengths, perm, capacity, ranks, segment):
    """Batches as sets of (rank, sample) in plan order, and the leftovers;
    every prefix is tried."""
    def fits(ids):
        loads, out = [0] * ranks, set()
        for p in sorted(range(len(ids)), key=lambda p: (-lengths[ids[p]], -p)):
            r = min(range(ranks), key=lambda r: (loads[r], r))
            loads[r] += lengths[ids[p]]
            out.add((r, ids[p]))
        return out if max(loads) <= capacity else None

    groups = [perm[i:i + segment] for i in range(0, len(perm), segment)]
    joined, batches = max(2, segment // ranks), []
    while True:
        lefts = []
        for g in groups:
            while len(g) >= ranks:
                k = max(k for k in range(1, len(g) + 1) if fits(g[:k]) is not None)
                batches.append(fits(g[:k]))
                g = g[k:]
            lefts.append(g)
        if len(groups) == 1:
            return batches, lefts[0]
        groups = [sum(lefts[i:i + joined], []) for i in range(0, len(lefts), joined)]


@pytest.mark.parametrize("segment", [8, 50, 10_000])
def test_plan_equals_brute_force(spark, segment):
    rng = random.Random(1)
    lens = [rng.choice([rng.randint(1, 300), rng.randint(200, 600)]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lens)), "sample_idx long, seq_len long")
    rows = PK.pack_plan(df, 512, 4, seed=3, epoch=0, segment_size=segment).collect()
    clipped = [min(x, 512) for x in lens]
    perm = [r["sample_idx"] for r in PK.epoch_order(df, 3, 0).orderBy("perm").collect()]
    batches, left = brute(clipped, perm, 512, 4, segment)
    got = {}
    for r in rows:
        got.setdefault(r["batch_id"], set()).add((r["rank"], r["sample_idx"]))
    assert sorted(i for _, i in got.pop(None, set())) == sorted(left) and len(left) < 4
    assert [got[k] for k in sorted(got)] == batches and sorted(got) == list(range(len(batches)))
    assert sorted(r["sample_idx"] for r in rows) == list(range(300))
    s = PK.plan_summary(spark.createDataFrame(rows), 512, 4).first()
    assert (s.n_samples, s.n_tokens, s.placed_twice, s.left_over, s.over_capacity, s.idle_ranks) == (300, sum(clipped), 0, 0, 0, 0)


def test_plan_does_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id AS sample_idx", "1 + id * 7919 % 400 AS seq_len")
    a, b = (sorted((tuple(r) for r in PK.pack_plan(x, 512, 4, seed=3, epoch=1, segment_size=40).collect()), key=repr)
            for x in (df.coalesce(1), df.repartition(13)))
    assert a == b


def test_few_samples(spark):
    for n in (0, 1, 3, 4):
        df = spark.range(n).selectExpr("id AS sample_idx", "10 AS seq_len")
        rows = PK.pack_plan(df, 64, 4, seed=1, epoch=0).collect()
        assert len(rows) == n and all((r["batch_id"] is None) == (n < 4) for r in rows)


def test_truncate_or_drop(spark):
    df = spark.createDataFrame([(0, 10), (1, 900)], "sample_idx long, seq_len long")
    assert sorted(r["seq_len"] for r in PK.clip_lengths(df, 100).collect()) == [10, 100]
    assert PK.clip_lengths(df, 100, truncate=False).count() == 1


def test_spread():
    # 5 -> rank 0, 4 -> rank 1, then the equal 3s, the later one first: to rank 1, then to rank 0
    assert PK.spread([5, 4, 3, 3], 8, 2) == [[0, 2], [1, 3]]
    assert PK.spread([9], 8, 2) is None


def test_write_plan_per_rank(spark, tmp_path):
    df = spark.createDataFrame([(i, 10 + i % 7) for i in range(40)], "sample_idx long, seq_len long")
    plan = PK.pack_plan(df, 64, 2, seed=1, epoch=3)
    PK.write_plan(plan, str(tmp_path / "plan"))
    r0 = spark.read.parquet(str(tmp_path / "plan" / "rank=0"))
    assert r0.count() > 0 and set(r0.columns) >= {"epoch", "batch_id", "ord", "sample_idx"}
    assert {r["epoch"] for r in r0.collect()} == {3}
