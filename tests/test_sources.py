"""Readers and writers round trips."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from draftkit.operators import metrics as M
from draftkit.operators import sample as R
from draftkit.operators import shape as Q
from draftkit.operators import vocab as V
from draftkit.sources import readers as S
from draftkit.sources import sinks as SK


def test_jsonl_sink_and_corrupt_lines(spark):
    d = tempfile.mkdtemp(prefix="dk-src-")
    p = os.path.join(d, "a.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"id": "1", "conversations": [{"from": "human", "value": "hi"}]}) + "\n")
        f.write("{not json\n")
    df = S.read_conversations(spark, p)
    assert [r["id"] for r in df.filter(F.col("_corrupt_record").isNull()).select("id").collect()] == ["1"]
    resp = R.response_rows(spark.createDataFrame([(5, "p", "o")], "idx long, prompt string, output string"), "idx", "prompt", "output")
    out = os.path.join(d, "responses")
    SK.append_jsonl(resp, out)
    SK.append_jsonl(resp, out)
    back = spark.read.json(out)
    assert back.count() == 2
    assert [r["key"] for r in R.seen_keys(back).collect()] == ["5"]
    with pytest.raises(ValueError):
        S.read_conversations(spark, os.path.join(d, "x.txt"))


def test_benchmark_json_and_listing(spark):
    d = tempfile.mkdtemp(prefix="dk-bench-")
    ok = lambda **kw: {"successful": kw}
    doc = {"args": {"data_args": [{"data_files": "/data/qa.jsonl"}]}, "benchmarks": [
        {"config": {"strategy": {"type_": "constant", "rate": 1.0}},
         "metrics": {"requests_per_second": ok(mean=1.0, median=1.1), "request_latency": ok(median=2.0),
                     "output_tokens": ok(sum=10.0)},
         "requests": {"successful": [{"output_tokens": 7}, {"output_tokens": 9}, {"output_tokens": 20}]}},
        {"config": {"strategy": {"type_": "throughput", "rate": 9.0}}, "metrics": {},
         "requests": {"successful": [{"output_tokens": 1000}]}}]}
    os.makedirs(os.path.join(d, "nested"))
    with open(os.path.join(d, "nested", "sweeps_qa.json"), "w") as f:
        json.dump(doc, f)
    b = S.read_results(spark, os.path.join(d, "nested", "sweeps_qa.json"))
    from draftkit.operators import evals as E
    rows = E.sweep_rows(b, E.subset_from_filename(F.col("file"))).collect()
    assert len(rows) == 1 and rows[0]["subset"] == "qa" and rows[0]["latency_median_s"] == 2.0
    assert rows[0]["total_output_tokens"] == 10.0
    pts = E.json_chart_points(b, "latency").collect()
    assert [(p["subset"], p["x"], p["y"]) for p in pts] == [("qa", 1.0, 2.0)]
    docs = S.read_benchmark_docs(spark, os.path.join(d, "nested", "sweeps_qa.json"))
    lens = E.gen_len_lengths(docs, F.lit("qa"))
    st = E.output_length_stats(lens, ["subset"]).first()
    assert (st["count"], st["median"], st["min"], st["max"], st["max_tokens"]) == (3, 9.0, 7, 20, 16)
    files = S.list_files(spark, d, glob="*.json", recursive=True).collect()
    assert len(files) == 1 and files[0]["path"].endswith("sweeps_qa.json")
    with pytest.raises(ValueError):
        S.read_results(spark, "x.parquet")


def test_small_helpers(spark):
    df = spark.createDataFrame([([1.0], [2.0], [3.0])], "hidden_states array<double>, verifier_last_hidden_states array<double>, x array<double>")
    c = Q.cast_hidden(df)
    assert c.schema["hidden_states"].dataType.simpleString() == "array<float>"
    assert c.schema["x"].dataType.simpleString() == "array<double>"
    assert "hidden_states_last" in Q.mtp_view(df).columns
    assert M.loss_by_name("ce") is M.cross_entropy
    with pytest.raises(ValueError):
        M.loss_by_name("mse")
    assert V.target_vocab_size(10, None) == 10
    for bad in ((10, "m"), (None, None)):
        with pytest.raises(ValueError):
            V.target_vocab_size(*bad)
    assert V.resolve_maps("a", "b", None, None) == "explicit"
    with pytest.raises(ValueError):
        V.resolve_maps("a", None, None, None)
    assert V.resolve_maps(None, None, None, "f") == "rebuild"
    assert V.resolve_maps(None, None, None, None) == "none"
    d = tempfile.mkdtemp(prefix="dk-feat-")
    R.feature_sink(spark.range(3), d + "/f", cache=True)
    R.feature_sink(spark.range(3), d + "/g", cache=False)
    assert spark.read.parquet(d + "/f").count() == 3 and not os.path.exists(d + "/g")


def test_size_for_input(spark):
    from draftkit.session import size_for_input
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        assert size_for_input(spark, 100 * 1024 ** 4) == 819_200      # 100 TiB / 128 MiB
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert size_for_input(spark, 64 * 1024 ** 3) == 512            # 64 GiB / 128 MiB
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(128 * 1024 * 1024)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_scratch_tables_are_removed(spark):
    import os
    from draftkit import session
    session._SCRATCH.clear()
    df = session.materialize(spark.range(3), "gone")
    assert df.count() == 3
    path = session._SCRATCH[0].removeprefix("file:")
    assert os.path.isdir(path) and session.remove_scratch(spark) == 1 and not os.path.exists(path)


def test_response_log_holds_all_documents(spark):
    from __spark_entry__ import queries
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries()["S6_R6_response_log_all"](spark, sf).collect()
    assert {(r["key"], r["n_rows"]) for r in got} == {(str(r["doc_id"]), 2) for r in docs.collect()}
    assert len(got) == docs.count() > docs.filter("lang = 'de'").count()


def test_a_run_made_again_adds_nothing(spark, tmp_path):
    from draftkit.sources.commits import append_run, committed
    a, b = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "x"), (2, "y")], [(3, "z")]))
    log = str(tmp_path / "log")
    assert SK.read_jsonl_runs(spark, log, a.schema).count() == 0
    assert [SK.append_jsonl(a, log, "r1"), SK.append_jsonl(b, log, "r2"), SK.append_jsonl(a, log, "r1")] == [True, True, False]
    with pytest.raises(ValueError, match="cut short"):  # a run that dies before its commit leaves nothing to read
        def dies(df, folder):
            df.write.json(folder)
            raise ValueError("cut short")
        append_run(a, log, "r3", dies)
    read = lambda: sorted(map(tuple, SK.read_jsonl_runs(spark, log, a.schema).collect()))
    assert read() == [(1, "x"), (2, "y"), (3, "z")] and sorted(committed(spark, log)) == ["r1", "r2"]
    assert SK.append_jsonl(a, log, "r3") and len(read()) == 5
    table = str(tmp_path / "table.csv")
    assert [SK.append_csv(a, table, ["v", "k", "none"], run_id="one") for _ in range(2)] == [True, False]
    assert spark.read.option("header", True).csv(committed(spark, table)["one"]).count() == 2
    for bad in ("", "a/b", "a@b", "_x"):
        with pytest.raises(ValueError, match="run id"):
            SK.append_jsonl(a, log, bad)


def test_half_a_pair_of_maps_is_none(spark, tmp_path):
    a, b = (spark.createDataFrame(r, "k long") for r in ([(1,)], [(2,)]))
    path = str(tmp_path / "maps")
    SK.write_vocab_maps(a, a, path)
    assert [d.first().k for d in SK.read_vocab_maps(spark, path)] == [1, 1]
    broken = b.select(F.raise_error(F.lit("lost")).cast("bigint").alias("k"))
    with pytest.raises(Exception, match="lost"):
        SK.write_vocab_maps(b, broken, path)
    with pytest.raises(FileNotFoundError):
        SK.read_vocab_maps(spark, path)
    SK.write_vocab_maps(b, b, path)
    assert [d.first().k for d in SK.read_vocab_maps(spark, path)] == [2, 2]
