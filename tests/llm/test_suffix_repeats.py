import random
from collections import defaultdict

import numpy as np
import pytest

from draftkit.llm import suffix_repeats as R
from draftkit.llm.queries import QUERIES


def brute(rows, length=R.MIN_WORDS):
    """All windows of ``length`` words of all rows; doc_id -> spans."""
    words = [(t or "").encode().split() for _, t in rows]
    holders = defaultdict(set)
    keys = [(t or "") for _, t in rows]
    for n, w in enumerate(words):
        for i in range(len(w) - length + 1):
            holders[tuple(w[i:i + length])].add(n)
    out = []
    for n, w in enumerate(words):
        spans = []
        copied = keys.count(keys[n]) > 1
        for i in range(len(w) - length + 1):
            if len({keys[m] for m in holders[tuple(w[i:i + length])]}) > 1 or copied:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        if spans:
            out.append((rows[n][0], ",".join(f"{a}:{b}" for a, b in spans)))
    return sorted(out, key=repr)


def test_selected_positions():
    rng = random.Random(1)
    for _ in range(40):
        w = np.array([rng.randrange(rng.choice([2, 50, 10**6])) for _ in range(rng.randint(0, 300))], np.uint64)
        at, g = R.selected(w, 12, 3)
        grams = R._mix(w, 3)
        want = {i + int(np.argmin(grams[i:i + 10] & ~R._POSITION)) for i in range(len(grams) - 9)}
        assert set(at.tolist()) == want and (g == grams[at]).all()


def test_long_texts_in_parts(monkeypatch):
    w = np.random.default_rng(0).integers(0, 1000, 5000).astype(np.uint64)
    one = R.selected(w)
    monkeypatch.setattr(R, "CHUNK", 700)
    assert all((a == b).all() for a, b in zip(one, R.selected(w)))


def made(rng, n_docs, passages, vocabulary=30):
    docs = []
    for d in range(n_docs):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            w += rng.choice([p, p[a:], p[:a], p[a:a + 15]]) + [f"u{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 12))]
        docs.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(8)}" for _ in range(n)] for k, n in enumerate([20, 30, 40, 12])]
    docs = made(rng, 70, passages) + [(900, "x " * 80), (901, "y x " * 3 + "x " * 60), (902, "z " * 80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = R.repeated_passages(df, length=18, gram=4).collect()
    assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == brute(docs, 18)
    assert all(r.repeated_words == sum(int(b) - int(a) for a, b in (s.split(":") for s in r.spans.split(","))) for r in got)


def test_further_neighbours_are_found(spark):
    """A suffix whose nearest neighbours on either side match on one side
    only, with the true partner behind them."""
    rng = random.Random(9)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    core, left, right = fresh(6), fresh(20), fresh(20)
    docs = [left + core + right[:12] + fresh(30), left[4:] + core + right[:14] + fresh(30)]
    docs += [fresh(30) + left[20 - k:] + core + right[:18] + fresh(30) for k in range(0, 4)]
    docs += [fresh(30) + left[1:] + core + right[:k] + fresh(30) for k in range(0, 4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    for length in (24, 30, 34):
        got = R.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), length=length, gram=4).collect()
        assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == brute(rows, length)


def test_edge_rows(spark):
    p = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"q{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, p), (3, p), (None, "a " + p), (5, long + " " + p + " " + long[:500]), (6, p + " " + p), (7, " ".join(p.split()[:50])), (8, long)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, pos int, `left` int")
    got = R.repeated_passages(df).collect()
    want = [x for x in brute(rows)]
    assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == want
    assert R.repeated_passages(df.where("false")).count() == 0


def test_query_against_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op8_sparse_suffix_repeats"][0](spark, sf).collect()
    assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == brute(rows) and got


@pytest.mark.parametrize("seed", range(20))
def test_outer_neighbours(seed):
    """Sorted rows cut anywhere: the nearest row of another text outside."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < 40:
        rows += [(rng.randrange(3), len(rows) + k, 0) for k in range(rng.choice([1, 2, 9]))]
    cuts = sorted({0, len(rows), *rng.sample(range(1, len(rows)), 8)})
    parts, want = {}, []
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        mine = [(t, f"l{i}", f"r{i}") for i, (t, _, _) in enumerate(rows)][a:b]
        known = {R.FIRST: mine[0], R.LAST: mine[-1]}
        runs = [i for i in range(1, len(mine)) if mine[i][0] != mine[i - 1][0]]
        if runs:
            known |= {R.AFTER_HEAD: mine[runs[0]], R.BEFORE_TAIL: mine[runs[-1] - 1]}
        parts[2 * p] = known
        for edge, text, places in ((R.HEAD, mine[0][0], range(a - 1, -1, -1)), (R.TAIL, mine[-1][0], range(b, len(rows)))):
            at = next((i for i in places if rows[i][0] != text), None)
            if at is not None:
                want.append((2 * p, edge, f"l{at}", f"r{at}"))
    assert sorted(R.outer_neighbours(parts)) == sorted(want)


def test_one_text_fills_partitions(spark, monkeypatch):
    """Runs of one text over several sort partitions, with and without the
    bit table."""
    rng = random.Random(2)
    docs = [(1, "x " * 3000), (2, "a b c " + "x " * 45 + "d e"), (3, "x y " * 800), (4, "q " + "x y " * 30 + "z"), (5, " ".join(f"u{i}" for i in range(200)))]
    docs += [(10 + i, " ".join(["x"] * rng.randint(1, 60) + [f"v{i}"] * rng.randint(1, 30))) for i in range(12)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for most in (R.TABLE_HASHES, 0):
            monkeypatch.setattr(R, "TABLE_HASHES", most)
            got = R.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), length=20, gram=4).collect()
            assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == brute(docs, 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
