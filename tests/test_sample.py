"""Sampling, sharding and resume."""

import datetime

import pytest
from pyspark.sql import functions as F

from draftkit.functions import select
from draftkit.functions.index import dense_index, running_sum
from draftkit.operators import sample as R
from draftkit.sources import readers as S


def test_rank_shards(spark):
    df = spark.range(10).select(F.col("id").alias("sample_idx"))
    r = [x["r"] for x in df.select(R.rank_of(F.col("sample_idx"), 10, 3).alias("r")).orderBy("sample_idx").collect()]
    assert r == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [R.shard_bounds(10, 3, k) for k in range(3)] == [(0, 4), (4, 7), (7, 10)]
    for n in (1, 2, 7, 31):
        for w in (1, 2, 3, 5):
            got = [x["r"] for x in spark.range(n).select(R.rank_of(F.col("id"), n, w).alias("r")).orderBy("id").collect()]
            want = [k for k in range(w) for _ in range(*R.shard_bounds(n, w, k))]
            assert got == want


def test_pending_caps_before_existing(spark):
    df = spark.range(10).select(F.col("id").alias("sample_idx"))
    ex = spark.createDataFrame([(1,), (8,)], "idx long")
    got = sorted(x["sample_idx"] for x in R.pending_for_rank(df, ex, 10, 6, 2, 0).collect())
    assert got == [0, 2]


def test_dense_index_and_running_sum_partition_invariant(spark):
    base = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    outs = []
    for n in (1, 4, 16):
        d = base.repartition(n)
        idx = {(r["o"]): r["i"] for r in dense_index(d, [F.col("k"), F.col("o").desc()], "i").collect()}
        rs = {(r["o"]): r["s"] for r in running_sum(d, ["k"], "o", "v", "s", bucket_width=16).collect()}
        outs.append((idx, rs))
    assert outs[0] == outs[1] == outs[2]
    idx, rs = outs[0]
    order = sorted(range(1000), key=lambda o: (o % 7, -o))
    assert [idx[o] for o in order] == list(range(1000))
    for o in range(1000):
        assert rs[o] == sum(x % 5 for x in range(o % 7, o, 7))


def test_failure_runs_bruteforce(spark):
    seq = {1: [1, 1, 0, 1, 1, 1, 0], 2: [0, 0], 3: [1, 1, 1, 1]}
    rows = [(k, i, bool(f)) for k, fs in seq.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "user_id long, t long, failed boolean")
    r = {x["user_id"]: (x["max_fail_run"], x["abort"]) for x in R.failure_runs(df, ["user_id"], ["t"], "failed", 3).collect()}
    assert r == {1: (3, True), 2: (0, False), 3: (4, True)}


def test_sidecar_lengths(spark):
    files = spark.createDataFrame([(0, 100, 9), (1, 150, 9), (2, 210, 9)], "file_id long, size long, len0_hint long")
    side = spark.createDataFrame([(0, 9), (1, 14), (2, 19)], "file_id long, length long")
    exact = {r["file_id"]: r["length"] for r in S.sample_lengths(files, side).collect()}
    assert exact == {0: 9, 1: 14, 2: 19}
    part = S.sample_lengths(files, side.filter("file_id <> 2"))
    got = {r["file_id"]: (r["length"], r["exact"]) for r in part.collect()}
    assert got == {0: (9, True), 1: (14, True), 2: (19, False)}  # ceil(210/100*9) = 19
    compat = {r["file_id"]: r["exact"] for r in S.sample_lengths(files, side.filter("file_id <> 2"), compat=True).collect()}
    assert not any(compat.values())


def test_feature_ids(spark):
    names = spark.createDataFrame([("a/hs_3.safetensors",), ("hs_x.safetensors",), ("hs_3.safetensors",), ("hs_10.safetensors",), ("data_1.pt",)], "name string")
    assert sorted(r["idx"] for r in S.feature_ids(names).collect()) == [3, 10]


def test_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return x * 2
    waits = []
    assert R.call_with_retries(flaky, 4, retries=3, sleep=waits.append) == (8, 3, None) and waits == [2.0, 4.0]

    def down(x):
        raise RuntimeError("down")
    waits.clear()
    assert R.call_with_retries(down, 1, sleep=waits.append) == (None, 4, "RuntimeError: down") and waits == [2.0, 4.0, 8.0]

    def bad(x):
        raise R.InvalidResponse("no ids")
    assert R.call_with_retries(bad, 1, retries=5, sleep=lambda s: None)[1] == 1


def test_bulk_call(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "idx long, prompt string")
    r = {x["idx"]: (x["out"], x["attempts"], x["error"]) for x in R.bulk_call(df, lambda row: row["prompt"].upper(), "out", "string").collect()}
    assert r == {1: ("A", 1, None), 2: ("BB", 1, None)}


def test_hot_key_running_sum_and_rank(spark):
    """One key holds a third of all rows: buckets split it, results exact."""
    n = 30000
    base = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("k"),
                                 F.col("id").alias("o"), F.lit(1).alias("v"))
    from draftkit.functions.index import group_rank
    r = group_rank(base, ["k"], "o", "rank", bucket_width=512)
    hot = r.filter("k = 0")
    assert hot.select(F.countDistinct(F.floor(F.col("o") / 512))).first()[0] > 10  # split over many buckets
    got = sorted((x["o"], x["rank"]) for x in hot.collect())
    assert [g[1] for g in got] == list(range(len(got)))
    idx = dense_index(base, ["k", "o"], "i").filter("k = 0").agg(F.min("i"), F.max("i")).first()
    assert (idx[0], idx[1]) == (0, n // 3 - 1)


def test_registered_call_retries(spark):
    from __spark_entry__ import queries
    from draftkit.plans.q_more import _lengths
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["out"], r["attempts"], r["error"]) for r in queries()["R18_bulk_call_retries"](spark, sf).collect()}
    docs = {r["doc_id"]: len(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    failed = {4: (-1, 4, "ConnectionError: busy"), 5: (-1, 1, "invalid response: no ids")}
    assert got == {i: failed.get(i % 6, (n, i % 6 + 1, None)) for i, n in docs.items()}
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    big = lambda rows: [(None if r["text"] is None else 2 ** 53 + 1, 1, None) for r in rows]
    assert [tuple(r) for r in R.bulk_call_batches(df, _lengths, "out", "bigint").orderBy("doc_id").collect()] == [(1, "a", 1, 1, None), (2, None, None, 1, None)]
    assert [r["out"] for r in R.bulk_call_batches(df.coalesce(1), big, "out", "bigint").orderBy("doc_id").collect()] == [2 ** 53 + 1, None]


def _plain_first(rows, n):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x.encode()) for x in r))[:n]


@pytest.mark.parametrize("settle", [3, 40, 100_000])
def test_first_in_order_of_any_size(spark, monkeypatch, settle):
    import random
    rnd = random.Random(settle)
    monkeypatch.setattr(select, "SETTLE", settle)
    monkeypatch.setattr(select, "RANGE_BITS", 3)
    ints = [(rnd.choice([None, -(2**62), 2**62, *range(-9, 9)]), k) for k in range(200)]
    texts = [(rnd.choice(["", "a", "ab", "sample_0000%d" % rnd.randrange(30), "é", "zz", "\U0001f600"]), k) for k in range(200)]
    for rows, kind in ((ints, "long"), (texts, "string")):
        df = spark.createDataFrame(rows, f"a {kind}, b long").repartition(5)
        for n in (0, 1, 7, 100, 199, 200, 500):
            got = [tuple(r) for r in select.first_in_order(df, ["a", "b"], n).collect()]
            assert _plain_first(got, n) == _plain_first(rows, n) and len(got) == min(n, 200)
    same = spark.createDataFrame([(1, "x")] * 50 + [(0, "y")] * 5 + [(2, "z")] * 5, "a long, t string").repartition(4)
    got = sorted(tuple(r) for r in select.first_in_order(same, ["a"], 30).collect())
    assert got == [(0, "y")] * 5 + [(1, "x")] * 25
    when = spark.createDataFrame([(datetime.datetime(2024, 1, d),) for d in range(1, 20)], "a timestamp")
    assert select.first_in_order(when, ["a"], 4).count() == 4


def test_capped_rows_do_not_meet_in_one_task(spark):
    """No ordered limit and no single partition in the plans, however large n."""
    df = spark.range(5000).select(F.col("id").alias("idx"), F.lit("a prompt").alias("prompt"), F.lit(0).alias("source_ord"))
    for out in (R.pre_cap(df, 1000, 1, "idx"), R.final_cap(df, 3000, 1, "idx"), R.final_cap(df, 3000, 1, "idx", compat=True), R.regeneration_queue(df, None, 3000)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "Limit" not in plan
        assert out.count() == 3000


def _server(**how):
    """Local, so that it travels by value."""
    class Server:
        """Fails for given rows; knows how many calls were in flight."""

        def __init__(self, bad=(), broken=()):
            self.bad, self.broken, self.now, self.peak = set(bad), set(broken), 0, 0

        def start(self):
            import threading
            self.lock = threading.Lock()

        def __call__(self, row):
            import time
            with self.lock:
                self.now += 1
                self.peak = max(self.peak, self.now)
            time.sleep(0.002 * (row["id"] % 3))
            with self.lock:
                self.now -= 1
            if row["id"] in self.broken:
                raise R.InvalidResponse("no")
            if row["id"] in self.bad:
                raise ConnectionError("gone")
            return self.peak

    return Server(**how)


def _plain_window(ids, scopes, bad, c, k):
    """Row by row: a call starts when the row c before it is done."""
    out, fails, closed = {}, {}, {}
    for j, i in enumerate(ids):
        s = scopes[i]
        done = [x for x in ids[:max(0, j - c + 1)] if scopes[x] == s]
        run = stop = 0
        for x in done:
            if out.get(x) == "not attempted":
                continue
            run = run + 1 if x in bad else 0
            stop = stop or run >= k
        out[i] = "not attempted" if stop else ("ConnectionError: gone" if i in bad else None)
    return out


def test_windowed_calls(spark):
    import random
    rnd = random.Random(1)
    ids = list(range(300))
    bad = {i for i in ids if rnd.random() < 0.5}
    scopes = {i: i // 60 for i in ids}
    df = spark.createDataFrame([(i, scopes[i], None if i % 7 == 0 else "t") for i in ids], "id long, s long, text string").coalesce(1).sortWithinPartitions("id")
    for c, k in ((1, 2), (4, 3), (16, 5)):
        rows = R.bulk_call_window(df, _server(bad=bad), "out", "bigint", concurrency=c, retries=0, stop_after=k, scope=["s"]).collect()
        assert [r.id for r in rows] == ids and all((r.text is None) == (r.id % 7 == 0) for r in rows)
        want = _plain_window(ids, scopes, bad, c, k)
        assert {r.id: r.error for r in rows} == want
        assert all(r.attempted == (r.error != "not attempted") and r.attempts == int(r.attempted) for r in rows)
        assert max(r.out or 0 for r in rows) <= c and all((r.out is None) == (r.error is not None) for r in rows)
        assert {r.s for r in rows if r.stopped} == {r.s for r in rows if not r.attempted}
    rows = R.bulk_call_window(df, _server(broken=[3]), "out", "bigint", concurrency=5, retries=1, base_delay=0).collect()
    assert max(r.out or 0 for r in rows) == 5 and [r.error for r in rows if r.error] == ["invalid response: no"]
    assert R.bulk_call_window(df.where("false"), _server(), "out", "bigint").count() == 0


def test_bulk_call_gets_small_batches(spark):
    """However many rows a partition has and whatever the session allows, a
    call gets at most 1000 rows (and 8 MB) at once; the windowed form, too."""
    for key, usual in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", "268435456")):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", usual)
    df = spark.range(5000).coalesce(1).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 20)).alias("text"))
    rows = R.bulk_call_batches(df, lambda rows: [(len(rows), 1, None) for _ in rows], "out", "bigint", inputs=["text"]).collect()
    assert sorted(r["k"] for r in rows) == list(range(5000)) and max(r["out"] for r in rows) <= 1000
    long = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = R.bulk_call_batches(long, lambda rows: [(len(rows), 1, None) for _ in rows], "out", "bigint").agg(F.max("out"), F.count("*")).first()
    assert sizes[0] <= 10 and sizes[1] == 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    R.bulk_call_window(df, lambda row: 1, "out", "bigint")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_retries_of_rows_without_an_id(spark, tmp_path):
    from __spark_entry__ import queries
    spark.createDataFrame([(None, "abc"), (7, None), (11, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["out"], r["attempts"], r["error"]) for r in queries()["R18_bulk_call_retries"](spark, str(tmp_path)).collect()}
    assert got == {None: (3, 1, None), 7: (-1, 2, None), 11: (-1, 1, "invalid response: no ids")}
