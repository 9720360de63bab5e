"""Streaming state across micro-batches equals the batch computation."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from draftkit.operators import sample as R
from draftkit.streaming import streams as X


def _write_parts(spark, rows, schema, parts):
    d = tempfile.mkdtemp(prefix="dk-stream-src-")
    for i, chunk in enumerate(parts(rows)):
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
    return d


def test_alarm_state_across_batches(spark):
    seq = {1: [1, 1, 0, 1, 1, 1, 1, 0], 2: [0, 1, 1, 0, 1], 3: [1, 1, 1]}
    rows = [(u, i, i * 60, bool(f)) for u, fs in seq.items() for i, f in enumerate(fs)]
    schema = "user_id long, event_id long, t long, failed boolean"
    src = _write_parts(spark, rows, schema, lambda r: [[x for x in r if x[1] < 3], [x for x in r if x[1] >= 3]])
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
         .withColumn("ts", F.timestamp_seconds("t")))
    out, ck = tempfile.mkdtemp(prefix="dk-x5-"), tempfile.mkdtemp(prefix="dk-x5ck-")

    def sink(b, e):
        b.withColumn("epoch", F.lit(e)).write.mode("append").parquet(out)
    q = X.failure_alarm(s, 3).writeStream.outputMode("update").foreachBatch(sink).option(
        "checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.parquet(out)
    assert r.select("epoch").distinct().count() == 2  # two micro-batches
    last = {x["user_id"]: x["s"]["max_fail_run"] for x in
            r.groupBy("user_id").agg(F.max_by(F.struct("max_fail_run"), "epoch").alias("s")).collect()}
    batch = spark.createDataFrame(rows, schema)
    want = {x["user_id"]: x["max_fail_run"] for x in R.failure_runs(batch, ["user_id"], ["t"], "failed", 3).collect()}
    assert last == want == {1: 4, 2: 2, 3: 3}


def test_counter_deltas_across_batches(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([5, 9, 9, 20])] + [("b", k, float(v)) for k, v in enumerate([1, 4])]
    schema = "series string, scrape long, value double"
    src = _write_parts(spark, rows, schema, lambda r: [[x for x in r if x[1] < 2], [x for x in r if x[1] >= 2]])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    out, ck = tempfile.mkdtemp(prefix="dk-x6-"), tempfile.mkdtemp(prefix="dk-x6ck-")
    q = X.counter_deltas(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(
        availableNow=True).start()
    q.awaitTermination()
    got = {(x["series"], x["scrape"]): x["delta"] for x in spark.read.parquet(out).collect()}
    assert got == {("a", 0): 5.0, ("a", 1): 4.0, ("a", 2): 0.0, ("a", 3): 11.0, ("b", 0): 1.0, ("b", 1): 3.0}


def test_dedup_within_watermark(spark):
    rows = [(i % 5, i) for i in range(20)]
    schema = "event_id long, t long"
    src = _write_parts(spark, rows, schema, lambda r: [r[:10], r[10:]])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    d = X.dedup_by_key(s.withColumn("ts", F.timestamp_seconds("t")), ["event_id"], "ts", "1 hour")
    out, ck = tempfile.mkdtemp(prefix="dk-x2-"), tempfile.mkdtemp(prefix="dk-x2ck-")
    q = d.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x["event_id"] for x in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_response_sink_restart(spark):
    rows = [(i, f"prompt {i}", f"answer {i}") for i in range(12)]
    schema = "idx long, prompt string, output string"
    src = _write_parts(spark, rows, schema, lambda r: [r[:6], r[6:]])
    out, ck = tempfile.mkdtemp(prefix="dk-s6-"), tempfile.mkdtemp(prefix="dk-s6ck-")

    def start():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        return X.response_sink(R.response_rows(s, "idx", "prompt", "output"), out, ck)
    start().awaitTermination()
    start().awaitTermination()  # restart: nothing new, nothing repeated
    back = spark.read.json(out)
    assert back.count() == 12
    assert sorted(r["key"] for r in R.seen_keys(back).collect()) == sorted(str(i) for i in range(12))


def _shuffled_parts(spark, sf, name, key, parts, tmp_path):
    """A table folder of part files that cut groups apart, newest first."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    rows = df.orderBy(F.desc(key)).collect()
    folder = tmp_path / f"{name}.parquet"
    folder.mkdir()
    for i in range(parts):
        one = tmp_path / f"one-{name}-{i}"
        spark.createDataFrame(rows[i::parts] if i % 2 else rows[i::parts][::-1], df.schema).coalesce(1).write.parquet(str(one))
        next(one.glob("part-*.parquet")).rename(folder / f"part-{i:04d}.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The streamed tables as folders of several files, in no order."""
    sf, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("sf-folders")
    for name, key in (("events", "ts"), ("documents", "doc_id"), ("conversations", "turn")):
        _shuffled_parts(spark, sf, name, key, 3, out)
    return str(out)


@pytest.mark.parametrize("name", ["X1_stream_prompt_intake", "X2_stream_dedup", "X3_stream_token_frequency", "X4_stream_windowed_tallies",
                                  "X5_stream_failure_alarm", "X5_stream_failure_alarm_tables", "X6_stream_counter_deltas", "X7_stream_incremental_build"])
def test_registered_streams_over_table_folders(spark, folders, name):
    import duckdb

    from draftkit.plans.catalog import REGISTRY
    fn, sql = REGISTRY[name]
    con = duckdb.connect()
    for t in ("events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folders}/{t}.parquet/*.parquet')")
    want = con.execute(sql).df()
    got = fn(spark, folders).toPandas()
    cols = sorted(got.columns)
    norm = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df[cols].itertuples(index=False)), key=repr)
    assert cols == sorted(want.columns) and norm(got) == norm(want) and len(got)


def test_replayed_epochs_change_nothing(spark, tmp_path):
    a, b = (spark.createDataFrame(r, "k long, v long") for r in ([(1, 1), (2, 1), (1, 2)], [(2, 2), (3, 1)]))
    first = lambda batch, earlier: batch.dropDuplicates(["k"]) if earlier is None else batch.dropDuplicates(["k"]).join(earlier.select("k"), "k", "left_anti")
    sink = X.epoch_sink(str(tmp_path / "out"), first)
    for batch, epoch in ((a, 0), (b, 1), (b, 1)):
        sink(batch, epoch)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.epoch) for r in got) == [(1, 0), (2, 0), (3, 1)]


def test_conversation_over_two_files_is_built_whole(spark, tmp_path):
    rows = [(1, 0, "a"), (2, 0, "b")], [(1, 1, "c"), (3, 0, "d")]
    schema = "conv_id long, turn long, text string"
    src = _write_parts(spark, rows, schema, lambda r: r)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    build = lambda d: d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    X.incremental_build(s, build, store, out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, X.latest_build(spark, out).collect())) == [(1, 2), (2, 1), (3, 1)]


def test_alarm_tables_out_of_order(spark):
    import random
    rnd = random.Random(5)
    seq = {u: [rnd.random() < 0.6 for _ in range(rnd.randint(1, 40))] for u in range(12)}
    seq[99] = [True] * 30  # hot, all-failure key spanning every batch
    rows = [(u, i, i * 60, bool(f)) for u, fs in seq.items() for i, f in enumerate(fs)]
    schema = "user_id long, event_id long, t long, failed boolean"
    src = _write_parts(spark, rows, schema, lambda r: [r[2::3], r[::3], r[1::3]])
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
         .withColumn("ts", F.timestamp_seconds("t")))
    state, ck = tempfile.mkdtemp(prefix="dk-x5t-"), tempfile.mkdtemp(prefix="dk-x5tck-")
    X.failure_alarm_tables(s, state, ck).awaitTermination()
    got = {r["user_id"]: r["max_run"] for r in X.alarm_table(spark, state, 3).collect()}
    want = {r["user_id"]: r["max_fail_run"] for r in
            R.failure_runs(spark.createDataFrame(rows, schema), ["user_id"], ["t"], "failed", 3).collect()}
    assert got == want and got[99] == 30


def test_alarm_row_takes_files_one_by_one(spark, monkeypatch):
    """The registered row: a micro-batch per file, files out of order, no
    whole key in pandas."""
    from __spark_entry__ import queries
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    sf = tempfile.mkdtemp(prefix="dk-x5-row-")
    for i, k in enumerate((2, 0, 1)):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
    batches = []
    run = X.run_epochs
    monkeypatch.setattr(X, "run_epochs", lambda stream, sink, ckpt: run(stream, lambda b, e: (batches.append(e), sink(b, e)), ckpt))
    monkeypatch.setattr(X, "failure_alarm", None)
    got = {r["user_id"]: (r["max_fail_run"], r["alarm"]) for r in queries()["X5_stream_failure_alarm"](spark, sf).collect()}
    runs = R.failure_runs(events.withColumn("failed", F.col("event_type") == "error"), ["user_id"], ["ts", "event_id"], "failed", 3)
    assert batches == [0, 1, 2] and got == {r["user_id"]: (r["max_fail_run"], r["abort"]) for r in runs.collect()}


def test_epochs_read_only_their_buckets(spark, tmp_path):
    """Fifty-odd epochs, some run twice: an epoch finds all earlier rows of
    its keys in its own buckets of a few folders."""
    from draftkit.streaming.state import BucketTable
    t = BucketTable(spark, str(tmp_path / "state"), ["k"], buckets=16, fan=4)
    assert t.blocks(0) == [] and t.blocks(50) == [(2, 0), (2, 16), (2, 32), (0, 48), (0, 49)] and t.blocks(4) == [(1, 0)]
    want = {}
    for epoch in range(51):
        rows = [(epoch % 7, epoch), (100 + epoch % 3, epoch)]
        batch = spark.createDataFrame(rows, "k long, v long").coalesce(1)
        for _ in range(2 if epoch in (4, 15, 16, 50) else 1):  # replays
            t.settle(epoch, batch.schema)
            touched = t.touched(batch)
            if epoch % 10 == 0 or epoch in (4, 16, 17):
                seen = t.before(epoch, batch.schema, touched)
                got = sorted(map(tuple, seen.join(batch.select("k").distinct(), "k", "left_semi").collect())) if seen is not None else []
                assert got == sorted((k, v) for k, _ in rows for v in want.get(k, []))
                files = seen.inputFiles() if seen is not None else []
                assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= set(touched) and len(touched) <= 2
                assert len({f.split("/bucket=")[0] for f in files}) <= 9  # three of each level
            t.put(batch, epoch)
        for k, v in rows:
            want.setdefault(k, []).append(v)
    everything = sorted(map(tuple, t.rows(batch.schema).collect()))
    assert everything == sorted((k, v) for k, vs in want.items() for v in vs)


def test_dedup_and_build_over_many_files(spark, tmp_path, monkeypatch):
    """Files in no order, an epoch run again in the middle, merged state."""
    import random

    from draftkit.streaming import state
    monkeypatch.setattr(state, "FAN", 2)
    monkeypatch.setattr(state.BucketTable.__init__, "__defaults__", (4, 2, None))
    rnd = random.Random(2)
    rows = [(None if k == 0 else k, rnd.randrange(50), f"t{rnd.randrange(5)}") for k in (rnd.randrange(12) for _ in range(80))]
    schema = "conv_id long, turn long, text string"
    src = _write_parts(spark, rows, schema, lambda r: [r[k::6] for k in range(6)])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    run = X.run_epochs
    monkeypatch.setattr(X, "run_epochs", lambda s, sink, ckpt: run(s, lambda b, e: [sink(b, e) for _ in range(2 if e in (1, 4) else 1)], ckpt))
    out = str(tmp_path / "dedup")
    X.dedup_table(stream(), ["conv_id", "turn"], out, str(tmp_path / "ck1"), buckets=4).awaitTermination()
    got = [(r.conv_id, r.turn) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:2] for r in rows}
    build = lambda d: d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("s"))
    built = str(tmp_path / "built")
    X.incremental_build(stream(), build, str(tmp_path / "store"), built, str(tmp_path / "ck2"), buckets=4).awaitTermination()
    want = {}
    for c, t, _ in rows:
        n, s = want.get(c, (0, 0))
        want[c] = (n + 1, s + t)
    assert {r.conv_id: (r.n, r.s) for r in X.latest_build(spark, built).collect()} == want


def test_summaries_add_up_in_time_order(spark):
    import itertools
    import random
    rnd = random.Random(9)
    rows = [(u, h, i, rnd.random() < (1.0 if h % 3 == 1 else 0.5)) for u in range(6) for h in range(6) for i in range(rnd.randint(0, 4))]
    df = spark.createDataFrame([(u, h, h * 100 + i, f) for u, h, i, f in rows], "u long, hour long, t long, failed boolean")
    got = {r.u: (r.max_run, r.current_run) for r in X.fold_summaries(X.run_summaries(df, ["u"], "hour", ["t"]), ["u"], "hour").collect()}
    want = {}
    for u, mine in itertools.groupby(rows, key=lambda r: r[0]):
        best = run = 0
        for *_, f in mine:
            run = run + 1 if f else 0
            best = max(best, run)
        want[u] = (best, run)
    assert got == want


def _update_epochs(frame, out, ck):
    """An update-mode stream into a folder per epoch, as the table forms do."""
    sink = X.epoch_sink(out, lambda batch, earlier: batch, history=False)
    frame.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()


def test_keyed_runs_out_of_order(spark, tmp_path):
    """Files in no order within the delay, small Arrow chunks, hours closed
    by timers: as the batch computation."""
    import random

    from draftkit.streaming import keyed
    rnd = random.Random(3)
    rows = [(u, i, i * 1500 + rnd.randrange(1000), rnd.random() < 0.7) for u in range(4) for i in range(rnd.randint(5, 30))]
    schema = "user_id long, event_id long, t long, failed boolean"
    src = _write_parts(spark, rows, schema, lambda r: [[x for x in r if x[1] // 8 == k][::-1] for k in (1, 0, 2, 3)])
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
         .withColumn("ts", F.timestamp_seconds("t")))
    chunk = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        _update_epochs(keyed.failure_alarm_state(s, 3, "5 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    got = {r.user_id: (r.max_fail_run, r.alarm) for r in keyed.last_rows(spark.read.parquet(str(tmp_path / "out")), ["user_id"]).collect()}
    runs = R.failure_runs(spark.createDataFrame(rows, schema), ["user_id"], ["t", "event_id"], "failed", 3)
    assert got == {r.user_id: (r.max_fail_run, r.abort) for r in runs.collect()}


def test_keyed_deltas_out_of_order(spark, tmp_path):
    from draftkit.streaming import keyed
    values = {"a": [5, 9, 9, 20, 26, 30], "b": [1, 4]}
    rows = [(s, 10_000 + k, float(v)) for s, vs in values.items() for k, v in enumerate(vs)]
    schema = "series string, scrape long, value double"
    src = _write_parts(spark, rows, schema, lambda r: [[x for x in r if x[1] % 10 in (3, 1)], [x for x in r if x[1] % 10 in (2, 5)], [x for x in r if x[1] % 10 in (0, 4)]])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    _update_epochs(keyed.counter_deltas_state(s, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.series, r.scrape): r.delta for r in keyed.last_rows(spark.read.parquet(str(tmp_path / "out")), ["series", "scrape"]).collect()}
    assert got == {(s, 10_000 + k): float(v - (vs[k - 1] if k else 0)) for s, vs in values.items() for k, v in enumerate(vs)}


class _State(dict):
    """Map state, value state and timers of one key, with counts of calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getMapState(self, *a):  # noqa: N802
        return self

    def getValueState(self, *a):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self, *a):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)


def _keyed(rows, batches, watermark=None, k=3):
    """Longest run after every batch of one key's rows, and the state."""
    from types import SimpleNamespace

    import pandas as pd

    from draftkit.streaming import keyed
    state, out = _State(), []
    p = keyed.RunProcessor(k)
    p.init(state)
    for n, batch in enumerate(batches):
        frame = pd.DataFrame([rows[i] for i in batch], columns=["us", "event_id", "failed"])
        got = [*p.handleInputRows((1,), iter([frame[:len(frame) // 2], frame[len(frame) // 2:]]), None)][0].iloc[0]
        out.append((got["max_fail_run"], got["current_run"]))
        for ms in sorted(t for t in state.timers if watermark and t <= watermark(n)):
            state.timers.discard(ms)
            [*p.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark(n)), SimpleNamespace(getExpiryTimeInMs=lambda: ms))]
    return out, state


def _slow_runs(rows):
    run = longest = 0
    for _, _, bad in sorted(rows):
        run = run + 1 if bad else 0
        longest = max(longest, run)
    return longest, run


def test_keyed_runs_read_what_a_batch_touches():
    """Rows in any order, with ties and repeats: exact after every batch; the
    work of a batch does not grow with the rows that came before."""
    import random
    rnd = random.Random(7)
    minute = 60_000_000
    rows = [(rnd.randrange(3000) * minute, rnd.randrange(5), rnd.random() < 0.8) for _ in range(6000)]
    order = [*range(6000)]
    batches = [order[a:a + 500] for a in range(0, 6000, 500)]
    out, state = _keyed(rows, batches)
    assert out == [_slow_runs(rows[:b[-1] + 1]) for b in batches]
    # a late stretch of rows in time order: few blocks a batch, many hours open
    rows = [(i * 40 * minute, i, rnd.random() < 0.8) for i in range(6000)]
    out, state = _keyed(rows, [range(a, a + 10) for a in range(0, 6000, 10)])
    assert out[-1] == _slow_runs(rows) and state.calls < 600 * 6


def test_keyed_runs_close_by_the_watermark():
    """Closed hours leave their blocks; later rows go on from them."""
    import random
    rnd = random.Random(8)
    second = 1_000_000
    rows = [(i * 20 * second + rnd.randrange(second), i, rnd.random() < 0.85) for i in range(5000)]
    batches = []
    for a in range(0, 5000, 250):
        b = [*range(a, a + 250)]
        rnd.shuffle(b)
        batches.append(b)
    # watermark two batches behind
    out, state = _keyed(rows, batches, lambda n: max(0, (n - 1) * 250 * 20 * 1000))
    assert out == [_slow_runs(rows[:(n + 1) * 250]) for n in range(len(batches))]
    assert sum(len(v[0]) for v in state.values()) < 1000
