"""Normalisation fixtures (shapes follow the reference's preprocessing tests)."""

from pyspark.sql import functions as F

from draftkit import schemas
from draftkit.operators import normalize as N
from draftkit.sources.readers import read_conversations


def _conv(spark, turns, key=1, keys=None):
    rows = [(k, [dict({f.name: None for f in schemas.RAW_TURN.fields}, **t) for t in turns]) for k in (keys or [key])]
    from pyspark.sql import types as T
    st = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turns", T.ArrayType(schemas.RAW_TURN))])
    return spark.createDataFrame(rows, st)


def _turns(df):
    return [r.asDict(recursive=True) for r in df.select(F.explode("turns").alias("t")).select("t.*").collect()]


def test_from_value_keys(spark):
    d = N.normalize_turns(_conv(spark, [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]))
    t = _turns(d)
    assert [(x["role"], x["content"]) for x in t] == [("user", "hi"), ("assistant", "yo")]


def test_role_content_with_system(spark):
    d = N.normalize_turns(_conv(spark, [{"role": "system", "content": "s"}, {"role": "user", "content": "u"},
                                        {"role": "assistant", "content": "a"}]))
    assert [x["role"] for x in _turns(d)] == ["system", "user", "assistant"]


def test_unknown_role_dropped(spark):
    d = N.normalize_turns(_conv(spark, [{"role": "user", "content": "u"}, {"role": "narrator", "content": "x"},
                                        {"role": "assistant", "content": "a"}]))
    assert [x["role"] for x in _turns(d)] == ["user", "assistant"]


def test_empty_value_falls_through_and_tool_calls(spark):
    tc = [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]
    d = N.normalize_turns(_conv(spark, [
        {"role": "user", "value": "", "content": "from content"},
        {"role": "assistant", "content": None, "tool_calls": tc},
        {"role": "tool", "content": "42", "tool_call_id": "c1"},
        {"role": "assistant", "content": "done", "tool_calls": []}]))
    t = _turns(d)
    assert t[0]["content"] == "from content"
    assert t[1]["content"] == "" and t[1]["tool_calls"][0]["function"]["name"] == "f"
    assert t[2]["tool_call_id"] == "c1"
    assert t[3]["tool_calls"] is None  # empty list is not kept


def test_thinking_mirrored(spark):
    d = N.normalize_turns(_conv(spark, [{"role": "user", "content": "q"},
                                        {"role": "assistant", "content": "a", "reasoning_content": "because"}]))
    t = _turns(d)[1]
    assert t["thinking"] == "because" and t["reasoning_content"] == "because"


def _json(spark, tmp_path, *lines):
    path = tmp_path / "chat.jsonl"
    path.write_text("\n".join(lines))
    return N.rename_messages(read_conversations(spark, str(path))).withColumnRenamed("conversations", "turns")


def test_texts_that_look_like_lists_stay_texts(spark, tmp_path):
    texts = ["[1] see the reference", "[INST] hi", '["a","b"]', " [", "[]", "{}", "null"]
    turns = ", ".join('{"role": "user", "content": %s}' % __import__("json").dumps(t) for t in texts)
    d = N.normalize_turns(_json(spark, tmp_path, '{"id": "1", "conversations": [%s]}' % turns))
    assert [(t["content"], t["parts"]) for t in _turns(d)] == [(t, None) for t in texts]
    d = N.normalize_turns(_conv(spark, [{"role": "user", "content": t} for t in texts]))
    assert [(t["content"], t["parts"]) for t in _turns(d)] == [(t, None) for t in texts]
    assert d.select(N.has_multimodal(F.col("turns")).alias("m")).first()["m"] is False


def test_value_wins_by_type(spark, tmp_path):
    d = _json(spark, tmp_path,
              '{"messages": [{"from": "human", "value": ["x"], "content": "no"}, {"from": "gpt", "value": "", "content": ["y", {"type": "text", "text": "z"}]},'
              ' {"from": "human", "value": [], "content": "c"}, {"from": "gpt", "value": "v", "content": ["w"]}, {"from": "human", "content": []}, {"from": "gpt", "value": 7}]}')
    got = _turns(N.normalize_turns(d))
    assert [(t["content"], t["parts"] and [p["text"] for p in t["parts"]]) for t in got] == [
        (None, ["x"]), (None, ["y", "z"]), ("c", None), ("v", None), ("", None), ("7", None)]


def test_multimodal_parts_and_rejects(spark, tmp_path):
    content = '["look", {"type": "image", "path": "img/a.png"}, {"type": "image", "base64": "AAA"}, {"type": "hologram"}]'
    d = N.normalize_turns(_json(spark, tmp_path, '{"conversations": [{"role": "user", "content": %s}, {"role": "assistant", "content": "ok"}]}' % content))
    parts = d.select(F.explode(F.col("turns")[0]["parts"]).alias("p"))
    conv = parts.select(N.media_part_to_url(F.col("p")).alias("r")).select("r.*").collect()
    assert conv[0]["type"] == "text" and conv[0]["text"] == "look" and conv[0]["reject"] is None
    assert conv[1]["type"] == "image_url" and conv[1]["url"] == "file:///img/a.png"
    assert "base64" in conv[2]["reject"]
    assert conv[3]["reject"].startswith("unknown content part")
    assert d.select(N.has_multimodal(F.col("turns")).alias("m")).first()["m"] is True


def test_empty_conversations_dropped(spark):
    d = N.normalize_turns(_conv(spark, [{"role": "narrator", "content": "x"}]))
    assert d.count() == 0


def test_turn_dropout_prefix_rule(spark):
    turns = [{"role": r, "content": f"t{i}"} for i, r in enumerate(["user", "assistant", "user", "assistant"])]
    rows = N.normalize_turns(_conv(spark, turns, keys=list(range(40))), dropout_seed=7).collect()
    for r in rows:
        kept = [t["role"] for t in r["turns"]]
        assert kept and kept[-1] == "assistant" and len(kept) in (2, 4)
    assert {len(r["turns"]) for r in rows} == {2, 4}  # both cut points drawn


def test_dropout_long_matches_nested(spark):
    rows = [(k, i, ["user", "assistant", "user", "assistant", "user"][i % 5], f"x{k}{i}") for k in range(30) for i in range(5)]
    long = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a = {(r["conv_id"], r["turn"]) for r in N.turn_dropout_rows(long, 3).collect()}
    nested = N.fold_turns(long).select("conv_id", F.transform("turns", lambda t: F.struct(
        F.lit(None).cast("string").alias("from"), t["role"].alias("role"), F.lit(None).cast("string").alias("value"),
        t["content"].alias("content"),
        F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("thinking"),
        F.lit(None).cast("string").alias("reasoning_content"))).alias("turns"))
    b = set()
    for r in N.normalize_turns(nested, dropout_seed=3).collect():
        for i, _t in enumerate(r["turns"]):
            b.add((r["conv_id"], i))
    assert a == b


def test_qa_and_prefix_and_path(spark):
    df = spark.createDataFrame([("q?", "a!", "coco/x.jpg"), ("q2", "a2", "other/y.jpg")], "question string, answer string, image string")
    q = N.qa_to_turns(df).first()["turns"]
    assert [(t["role"], t["content"]) for t in q] == [("user", "q?"), ("assistant", "a!")]
    f = N.prefix_filter(df, "image", "coco/")
    assert f.count() == 1
    p = f.select(N.rewrite_path("image", "coco/", "/data/coco").alias("p")).first()["p"]
    assert p == "/data/coco/x.jpg"
    listing = spark.createDataFrame([("/data/coco/x.jpg",)], "path string")
    ok = N.check_paths(f.withColumn("p", N.rewrite_path("image", "coco/", "/data/coco")), "p", listing, strict=False)
    assert ok.first()["reject_reason"] is None
