"""Rendering, tokenising and masks."""

import pytest
import regex
from pyspark.sql import functions as F

from draftkit.functions.text import TOKEN_PATTERN
from draftkit.operators import tokens as TK
from draftkit.plans import prepare as P


def test_overlap_mask_literal(spark):
    # text, offsets and pattern as in the reference's mask test
    text = "User: Hello\nAssistant: Hi there!\nUser: How are you?\nAssistant: Good!"
    pattern = r"Assistant: (.*?)(?=\n|$)"
    offsets = [(0, 4), (4, 5), (6, 11), (11, 12), (12, 21), (21, 22), (23, 25), (26, 31), (31, 32), (32, 33),
               (33, 37), (37, 38), (39, 42), (43, 46), (47, 51), (51, 52), (52, 61), (61, 62), (63, 67), (67, 68)]
    df = spark.createDataFrame([(text, [{"start": a, "end": b} for a, b in offsets])],
                               "text string, offsets array<struct<start:int,end:int>>")
    m = TK.with_assistant_mask(df, "text", "offsets", pattern, "m").first()["m"]
    assert [i for i, x in enumerate(m) if x] == [6, 7, 8, 18, 19]


def test_no_match_and_empty_offsets(spark):
    df = spark.createDataFrame([("nothing here", [{"start": 0, "end": 7}]), ("x", [])],
                               "text string, offsets array<struct<start:int,end:int>>")
    r = TK.with_assistant_mask(df, "text", "offsets", r"Assistant: (.*)", "m").collect()
    assert r[0]["m"] == [False] and r[1]["m"] == []


def _probe_rows(spark):
    rows = [(1, 0, "user", "USER words here"), (1, 1, "assistant", "ASSISTANT reply text"),
            (1, 2, "user", "second USER turn"), (1, 3, "assistant", "final ASSISTANT answer")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_template_families_detected_pattern(spark):
    """Law: the detected pattern's spans contain the assistant words and no
    user words, for every template family."""
    for name, t in TK.TEMPLATES.items():
        pat = TK.assistant_pattern(t)
        text = t.render_local([{"role": "user", "content": "USER words here"},
                               {"role": "assistant", "content": "ASSISTANT reply text"},
                               {"role": "user", "content": "second USER turn"},
                               {"role": "assistant", "content": "final ASSISTANT answer"}])
        spans = [text[m.start(1):m.end(1)] for m in regex.finditer(pat, text, regex.DOTALL)]
        joined = " ".join(spans)
        assert "ASSISTANT reply text" in joined and "final ASSISTANT answer" in joined, name
        assert "USER" not in joined, name


def test_per_turn_tokens_equal_whole_text(spark):
    """Tokenising per turn equals tokenising the rendered text (template
    boundaries cannot join tokens), and the template mask equals the
    overlap mask of the detected pattern."""
    rows = _probe_rows(spark)
    for name, t in TK.TEMPLATES.items():
        tok = TK.turn_tokens(rows, t)
        got = [x for r in tok.orderBy("ord").collect() for x in zip(r["tokens"], r["mask"])]
        text = t.render_local([{"role": r["role"], "content": r["text"]} for r in rows.orderBy("turn").collect()])
        whole = [(m.group(0), m.start(), m.end()) for m in regex.finditer(TOKEN_PATTERN, text)]
        assert [g[0] for g in got] == [w[0] for w in whole], name
        spans = [(m.start(1), m.end(1)) for m in regex.finditer(TK.assistant_pattern(t), text, regex.DOTALL)]
        ov = [any(e > s0 and s < e0 for s0, e0 in spans) for _, s, e in whole]
        assert [g[1] for g in got] == ov, name


def test_truncation_and_min_valid(spark):
    long_text = " ".join(f"w{i}" for i in range(1000))
    rows = spark.createDataFrame([(1, 0, "user", long_text), (1, 1, "assistant", "short answer"),
                                  (2, 0, "user", "q"), (2, 1, "assistant", "a b c")],
                                 "conv_id long, turn long, role string, text string")
    s = P.prepared_samples(rows, "chatml", 100).collect()
    lens = {r["conv_id"]: r["seq_len"] for r in s}
    assert lens[1] == 100 and lens[2] < 100
    for r in s:
        assert len(r["input_ids"]) == len(r["loss_mask"]) == r["seq_len"]
    # conversation 2 has exactly 3 trainable tokens: threshold 3 keeps, 4 drops
    keep = {r["conv_id"] for r in P.prepared_samples(rows, "chatml", 100, minimum_valid_tokens=3).collect()}
    drop = {r["conv_id"] for r in P.prepared_samples(rows, "chatml", 100, minimum_valid_tokens=4).collect()}
    assert 2 in keep and 2 not in drop


def test_mask_runs(spark):
    rows = spark.createDataFrame([(1, i, t, m) for i, (t, m) in enumerate(
        [("a", False), ("b", False), ("c", True), ("d", True), ("e", False)])],
        "conv_id long, pos long, token string, trainable boolean")
    r = TK.mask_runs(rows).orderBy("run").collect()
    assert [(x["trainable"], x["text"]) for x in r] == [(False, "a b"), (True, "c d"), (False, "e")]


def test_mask_source_choice():
    t = TK.TEMPLATES["chatml"]
    assert TK.choose_mask_source("X(.*)", t) == ("pattern", "X(.*)")
    assert TK.choose_mask_source(None, t)[0] == "template"


def test_tokenizer_file_path_and_regex_mask(spark, tmp_path):
    """T4 (b) with a tokenizers JSON file, then T5/T6 on its offsets."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    words = ["User", "Assistant", ":", "Hello", "Hi", "there", "!", "How", "are", "you", "?", "Good", "[UNK]"]
    tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation()])
    path = str(tmp_path / "tok.json")
    tok.save(path)
    text = "User: Hello\nAssistant: Hi there!\nUser: How are you?\nAssistant: Good!"
    df = spark.createDataFrame([(text,)], "text string")
    enc = df.select("text", TK.encode_with_tokenizer(F.col("text"), path).alias("e")).select("text", "e.*")
    r = TK.with_assistant_mask(enc, "text", "offsets", r"Assistant: (.*?)(?=\n|$)").first()
    toks = [text[o["start"]:o["end"]] for o in r["offsets"]]
    assert [t for t, m in zip(toks, r["loss_mask"]) if m] == ["Hi", "there", "!", "Good", "!"]
    short = df.select(TK.encode_with_tokenizer(F.col("text"), path, max_length=3).alias("e")).first()["e"]
    assert len(short["ids"]) == 3


def test_prepare_with_tokenizer_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers
    from draftkit.operators import vocab as V
    words = ["<", "|", "im", "_", "start", "end", ">", "user", "assistant", "hello", "world", "yes", "no", "[UNK]"]
    tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation()])
    path = str(tmp_path / "tok.json")
    tok.save(path)
    rows = spark.createDataFrame([(1, 0, "human", "hello world"), (1, 1, "gpt", "yes yes no"),
                                  (2, 0, "user", "world"), (2, 1, "assistant", "no")],
                                 "conv_id long, turn long, role string, text string")
    s = {r["conv_id"]: r for r in P.prepared_samples_tokenizer(rows, path, "chatml", 64).collect()}
    ids = {w: i for i, w in enumerate(words)}
    got1 = [i for i, m in zip(s[1]["input_ids"], s[1]["loss_mask"]) if m]
    assert got1 == [ids["yes"], ids["yes"], ids["no"]] and s[1]["n_spans"] == 1
    freq = {r["token_id"]: r["freq"] for r in V.token_frequency(
        P.prepared_samples_tokenizer(rows, path, "chatml", 64)).collect()}
    assert freq == {ids["yes"]: 2, ids["no"]: 2}


@pytest.mark.parametrize("max_bytes", [4000, 300, 1])
def test_ids_beyond_the_broadcast_bound(spark, monkeypatch, max_bytes):
    """Frequent tokens by broadcast, rare ones by distinct (token, sample)
    pairs: equal samples, and no exchange of a row per token."""
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = sorted((r.conv_id, r.input_ids, r.loss_mask, r.seq_len) for r in P.prepared_samples(conv).collect())
    plans, write = [], TK.materialize

    def noted(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(TK, "materialize", noted)
    monkeypatch.setattr(P, "BROADCAST_MAX_BYTES", max_bytes)
    out = P.prepared_samples(conv)
    assert sorted((r.conv_id, r.input_ids, r.loss_mask, r.seq_len) for r in out.collect()) == want
    held = dict(plans)["sample-tokens"]
    # one exchange, of turns to their sample; the others number the vocabulary's partitions
    assert [x.split("hashpartitioning(")[1].split("#")[0] for x in held.split("\n") if "Exchange hash" in x and "_pid" not in x] == ["conv_id"]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = {x.split("hashpartitioning(")[1].split("#")[0] for x in plan.split("\n") if "Exchange hash" in x}
    assert dealt <= {"conv_id", "token", "_pid"} and "posexplode" not in plan


def test_samples_within_the_length_are_not_joined(spark):
    rows = [(c, t, "user", "one two three") for c in range(3) for t in range(2)]
    tok = TK.turn_tokens(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TK.TEMPLATES["chatml"])
    assert TK.cut_long(tok, 1000) is tok and TK.cut_long(tok, 5) is not tok


def test_sweep_equals_span_by_span(spark):
    import random
    rnd = random.Random(4)
    rows = []
    for k in range(60):
        cuts = sorted(rnd.sample(range(80), rnd.choice([0, 2, 10, 30])))
        offsets = [{"start": a, "end": b} for a, b in zip(cuts, cuts[1:])] + ([{"start": 5, "end": 5}] if k % 9 == 0 else [])
        spans = [{"start": a, "end": a + rnd.choice([0, 1, 3, 25])} for a in sorted(rnd.choices(range(80), k=rnd.choice([0, 1, 4])))]
        rows.append((k, f"t{k}" if k % 5 else None, offsets if k % 11 else None, spans))
    df = spark.createDataFrame(rows, "k long, text string, offsets array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>").repartition(3)
    got = {r.k: (r.text, r.offsets, r.spans, r.m) for r in TK.overlap_mask_sweep(df, ["k"], "offsets", "spans", "m").collect()}
    want = {r.k: (r.text, r.offsets, r.spans, r.m) for r in df.withColumn("m", TK.overlap_mask(F.col("offsets"), F.col("spans"))).collect()}
    assert got == want and any(any(r[3] or ()) for r in got.values())
    dealt = TK.overlap_mask_sweep(df.repartition("k"), ["k"], "offsets", "spans", "m")._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("Exchange") == 1


def test_spans_are_made_in_small_batches(spark):
    """Whole texts travel in batches of bounded rows and bytes, and a span
    takes eight bytes: a worker's memory does not grow with the table."""
    import tracemalloc

    for key, usual in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", "268435456")):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", usual)
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string").select("text", TK.token_offsets(F.col("text")).alias("o"),
                                                                                 TK.assistant_spans(F.col("text"), "(b)").alias("s"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    got = {r.text: ([tuple(x) for x in r.o], [tuple(x) for x in r.s]) for r in df.collect()}
    assert got == {"a b": ([(0, 1), (2, 3)], [(2, 3)]), None: ([], []), "": ([], [])}
    tracemalloc.start()
    spans = TK.span_lists((((i, i + 1) for i in range(200_000)) for _ in range(2)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and len(spans) == 2 and spans[1][199_999].as_py() == {"start": 199_999, "end": 200_000}
