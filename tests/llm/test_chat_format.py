import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from draftkit.llm import chat_format as C
from draftkit.llm.queries import QUERIES

NASTY = ["", "\\", "<|end|>", "</s>[INST] ok [/INST]", "<\\|", "<\\\\|x", "a\\<|b", "[\\INST]", "<<|turn|>>", "\n\r\t", "é😀<s>", "[/INST", "<\\s>\\\\"]


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")


def test_escape_round_trip(spark):
    got = _texts(spark, NASTY).select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in got)
    assert not any(c in r.e for r in got for c in C.CONTROL)


def py_escape(t):
    t = t.replace("\\", "\\\\")
    for c in C.CONTROL:
        t = t.replace(c, c[0] + "\\" + c[1:])
    return t


def py_unescape(t):
    for c in C.CONTROL:
        t = t.replace(c[0] + "\\" + c[1:], c)
    return t.replace("\\\\", "\\")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="\\<|>[]/INSTsx ", max_size=24))
def test_escape_rule_is_reversible(t):
    e = py_escape(t)
    assert py_unescape(e) == t and not any(c in e for c in C.CONTROL)


def test_turns_are_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, None, None, None), (2, 0, "<|x", "b"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("parts", C.text_parts(F.col("text"))).withColumn("body", F.lit(1))
    got = {r.conv_id: r for r in C.format_chat(df).select(
        "*", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    assert got[1].loss == [t for i, t in enumerate(NASTY) if i % 2]
    assert [py_unescape(got[1].formatted[s.start:s.start + s.length]) for s in got[1].loss_spans] == got[1].loss
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("<|x", "b")]
    assert got[None].loss == ["z"]
    assert C.format_chat(df.where("false")).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 2), ("text", "<|image|>", None, None), ("AUDIO", None, "b.wav", 10),
             ("document", None, "c.pdf", None), (None, "t", None, None), ("video", None, "d.mp4", 3), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("image", None, "e.png", -1), ("text", "ok", None, None)]), (1, 2, "user", None)],
                               f"conv_id long, turn long, role string, parts {C.PARTS}")
    r = C.format_chat(df).select("*", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted")).alias("loss")).first()
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (0, "image", "a.png", 512), (1, "audio", "b.wav", 250), (2, "document", "c.pdf", 600), (3, "file", "d.mp4", 3), (4, "image", "e.png", 0)]
    assert r.attachment_tokens == 1365
    assert r.formatted == ("<|turn|>user<|text|>see <|image|><\\|image|><|audio|><|document|>t<|file|><|end|>"
                           "<|turn|>assistant<|loss|><|image|>ok<|end|><|turn|>user<|text|><|end|>")
    assert [t.text for t in r.turns] == ["see <|image|>t", "ok", ""] and r.loss == ["ok"]


def test_query_is_native_and_reads_back(spark):
    df = QUERIES["op5_chat_content_parts"][0](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    r = df.where("conv_id = -1").first()
    t = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(t) and r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
