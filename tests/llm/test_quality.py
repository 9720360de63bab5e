import zlib

import numpy as np
import pytest

from draftkit.llm import quality as Q
from draftkit.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def slow_contexts(texts):
    dims, signs = Q.index_vectors()
    out = np.zeros((Q.BUCKETS, Q.DIM))
    for t in texts:
        code = [Q._buckets()[w] for w in t.split()]
        letters, shapes = [c % Q.LETTERS for c in code], [Q.LETTERS + c // Q.LETTERS for c in code]
        for s in (letters, shapes):
            for i in range(len(s)):
                for j in range(max(0, i - Q.REACH), min(len(s), i + Q.REACH + 1)):
                    if i != j:
                        for e in range(Q.ENTRIES):
                            out[s[i], dims[s[j], e]] += signs[s[j], e]
    return out


def test_context_table_is_that_of_the_whole_corpus(spark):
    texts = ["The cat sat on the cat", "", "the dog sat", "A!! B!! 99 x", "one"] * 3 + ["y " * 50]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(5)
    assert (Q.corpus_contexts(df) == slow_contexts(texts)).all()


def test_pooling():
    vectors = Q.word_vectors(slow_contexts(["a b c d a b"]))
    x = Q.pooled(["a a b", "", "c"], vectors)
    letters = [Q._buckets()[w] % Q.LETTERS for w in "a a b".split()]
    assert np.allclose(x[0, :2 * Q.DIM], vectors[letters].mean(axis=0), atol=1e-6)
    assert x[0, 6 * Q.DIM] == pytest.approx(1 / 3) and not x[1].any()


def test_network_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, Q.FEATURES))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(0, .7, 2000) > 0).astype(float)
    check = np.arange(2000) % 4 == 0
    net = Q.Network().fit(x, y, check)
    raw = net.logits(x[check])
    loss = lambda t: np.mean(np.logaddexp(0, -(2 * y[check] - 1) * raw / t))
    assert net.temperature > 1.2 and loss(net.temperature) < loss(1.0)
    assert ((net.scores(x[check]) > .5) == y[check]).mean() > .65


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 60_000), (4, "good words here"), (4, "good words here"), (None, "no id")]
    df = spark.createDataFrame([(*r, 0., 1) for r in rows], "doc_id long, text string, score double, y int")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    got = Q.score_quality(df, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 0 for i, _ in rows}
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 60)] + [(4, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.score_quality(df, labels).collect())
    assert Q.score_quality(df.where("false"), labels).count() == 0
    out = Q.drop_low_quality(df, none)
    assert out.columns == df.columns and out.count() == 6


def test_held_out_labels_are_not_read(spark):
    """Other labels for held-out rows change no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]))
    a, b = ({r.doc_id: r.score for r in Q.score_quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_query_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op4_quality_random_indexing"][0](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in known if got[i].held_out]
    assert len(held) > 40
    assert np.mean([got[i].predicted == known[i] for i in held]) > 0.95
    bad = [got[i].score for i in held if known[i] == 0]
    good = [got[i].score for i in held if known[i] == 1]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def slow_features(text, vectors):
    code = [Q._buckets()[w] for w in text.split()]
    if not code:
        return np.zeros(Q.FEATURES)
    letters, shapes = [c % Q.LETTERS for c in code], [Q.LETTERS + c // Q.LETTERS for c in code]
    a = sum(vectors[i].astype(float) for i in letters) / len(code)
    b = sum(vectors[i].astype(float) for i in shapes) / len(code)
    share = sum(x == y for x, y in zip(letters, letters[1:])) / len(code)
    return np.concatenate([a, b, share * vectors[Q.SAME], [share, np.sqrt((a[Q.DIM:] ** 2).sum()), np.log(1 + len(code)) / 10]])


def test_scores_by_brute_force(spark):
    """Contexts, pooling and both layers word by word; only the fit's descent
    is shared."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    vectors = Q.word_vectors(slow_contexts(texts.values()))
    learn = sorted(i for i in labels if i in texts and labels[i] is not None and zlib.crc32(str(i).encode()) % 5)
    x = {i: slow_features(t, vectors) for i, t in texts.items()}
    check = np.array([zlib.crc32(f"check {i}".encode()) % 5 == 0 for i in learn])
    net = Q.Network().fit(np.array([x[i] for i in learn]).astype(np.float32).astype(float), np.array([float(labels[i]) for i in learn]), check)
    w1, b1, w2, b2 = net.weights
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op4_quality_random_indexing"][0](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i in texts:
        z = [(v - m) / s for v, m, s in zip(x[i], net.mean, net.scale)]
        h = [np.tanh(sum(a * w for a, w in zip(z, w1[:, k])) + b1[k]) for k in range(len(b1))]
        score = 1 / (1 + np.exp(-(sum(a * w for a, w in zip(h, w2)) + b2) / net.temperature))
        assert got[i][0] == pytest.approx(score, abs=1e-3) and (abs(score - 0.3) < 1e-3 or got[i][1] == (score >= 0.3))


def test_buckets_of_new_words_cost_little():
    """As letter by letter; most of the time goes to words not met before,
    so finding a bucket calls no Python function per letter."""
    import sys

    words = ["Hello", "hello,", "x" * 90, "\u0130stanbul", "A1-b2--C33", "\u4e2d\u6587", "!!!", "\u0663\u0664", "aB" * 40, "e\u0301te\u0301"]
    for w in words:
        shape = []
        for c in w[:64]:
            k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
            if not shape or shape[-1] != k:
                shape.append(k)
        letters = "".join(c for c in w.lower() if c.isalnum())
        assert Q.Buckets()[w] == zlib.crc32(letters.encode()) % Q.LETTERS + Q.LETTERS * (zlib.crc32("".join(shape[:8]).encode()) % Q.SHAPES)
    lines = []
    sys.settrace(lambda frame, event, arg: (lambda *a: lines.append(a[1])) if "quality" in frame.f_code.co_filename else None)
    try:
        Q.Buckets()["aZ" * 40]
    finally:
        sys.settrace(None)
    assert len(lines) < 40
