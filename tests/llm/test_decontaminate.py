import itertools
import random

import numpy as np
import pytest

from draftkit.llm import decontaminate as D
from draftkit.llm.queries import QUERIES


@pytest.mark.parametrize("n,bad", [(13, 2), (15, 3), (20, 4)])
def test_masks_hit_every_pattern(n, bad):
    for miss in itertools.combinations(range(n), bad):
        ok = [i not in miss for i in range(n)]
        assert any(all(ok[i + j] for j, c in enumerate(m) if c == "1") for m in D.MASKS for i in range(n - len(m) + 1))


def slow_stretch(eq):
    best = 0
    for a in range(len(eq)):
        for b in range(a + 1, len(eq) + 1):
            if 5 * sum(eq[a:b]) >= 4 * (b - a):
                best = max(best, b - a)
    return best


def test_stretch():
    rng = random.Random(1)
    for _ in range(300):
        eq = [rng.random() < rng.choice([.3, .8, .9]) for _ in range(rng.randint(0, 40))]
        u, v = D.stretch(np.array(eq, bool))
        assert v - u == slow_stretch(eq) and 5 * sum(eq[u:v]) >= 4 * (v - u)


def brute(docs, items):
    """All items laid on all documents at all offsets."""
    out = set()
    for d, t in docs:
        x = D.word_hashes(t or "")
        for i, s in items:
            w = D.word_hashes(s or "")
            for k in range(-len(w) + 1, len(x)):
                a, b = max(0, -k), min(len(w), len(x) - k)
                if len(w) and b - a >= min(D.MIN_WORDS, len(w)):
                    u, v = D.stretch(w[a:b] == x[a + k:b + k])
                    if v - u >= D.MIN_WORDS or len(w) < D.MIN_WORDS and (w[a:b] == x[a + k:b + k]).sum() == len(w):
                        out.add((d, i))
    return out


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_against_all_offsets(spark):
    rng = random.Random(7)
    items = [(i, words(rng, n)) for i, n in enumerate([5, 6, 8, 13, 14, 20, 40, 60, 4, 300, 1, 2, 3])]
    docs = []
    for d in range(60):
        x = words(rng, rng.randint(0, 150))
        _, w = rng.choice(items)
        a = rng.randrange(len(w))
        part = [y if rng.random() > rng.choice([0, .1, .2, .3]) else "other" for y in w[a if rng.random() < .5 else 0:]]
        at = rng.randint(0, len(x))
        docs.append((d, " ".join(x[:at] + part + x[at:]).replace("w1", "W1,").upper() if d % 2 else "\n".join(x[:at] + part + x[at:])))
    items = [(i, " ".join(w) + ".") for i, w in items]
    got = {(r.doc_id, r.item_id) for r in D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                                                     spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 20


def test_edge_rows(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, leak, 0), (1, leak, 0), (None, leak + " x", 0), (3, None, 0), (4, "", 0), (5, "--- !! ??", 0)],
                                  "item_id long, text string, words int")
    long = " ".join(f"q{i}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, f"{long} {leak.upper()}!"), (4, long), (5, f"a {leak}"), (5, f"a {leak}"), (None, leak), (6, "--- !! ??")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, item_id int, n_words string")
    got = D.overlaps(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_words, r.doc_start) for r in got), key=repr) == sorted(
        [(d, i, 14, s) for d, s in ((3, 100_000), (5, 1), (5, 1), (None, 0)) for i in (1, 1, None)], key=repr)
    out = D.drop_contaminated(docs, items)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 6]
    assert D.overlaps(docs, items.where("false")).count() == 0 and D.overlaps(docs.where("false"), items).count() == 0
    assert D.drop_contaminated(docs, items.where("false")).count() == len(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    run = QUERIES["op9_decontaminate_spaced_seeds"][0]
    one = sorted(map(tuple, run(spark, sf).collect()))
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = sorted(r.doc_id for r in D.drop_contaminated(docs, items).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, run(spark, sf).collect())) == one
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, items).collect()) == clean


def test_items_of_few_words_are_a_choice(spark):
    docs = spark.createDataFrame([(1, "say hello world again"), (2, "hello there"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Hello, world!"), (2, "there"), (3, "a b c d")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_words) for r in D.overlaps(docs, items).collect()) == [(1, 1, 2), (2, 2, 1)]
    assert [(r.doc_id, r.item_id) for r in D.overlaps(docs, items, min_item=2).collect()] == [(1, 1)]


def test_an_opening_that_many_items_share_is_cheap():
    """Figures do not matter here, only that a hit is no step of a loop."""
    import time
    rng = random.Random(3)
    opening = words(rng, 6)
    texts = [opening + words(rng, 34) for _ in range(5000)]
    index = D.Index([(i, D.word_hashes(" ".join(w)).tobytes()) for i, w in enumerate(texts)])
    clean = words(rng, 400)
    five = [w for k in range(5) for w in clean[80 * k:80 * k + 80] + opening]
    leak = clean[:100] + texts[77][2:30] + clean[100:]
    docs = [D.word_hashes(" ".join(d)) for d in (clean + opening, five, leak)]
    assert [h[:2] for h in index.hits(docs)] == [(2, 77)]
    began = time.process_time()
    for _ in range(10):
        assert [*index.hits(docs[:1])] == []
    assert time.process_time() - began < 1  # a hundredth of a second each on a quiet machine


def holders(docs, items):
    """(doc, item) of all that share three words in a row and, laid on each
    other there, a long enough stretch; without the masks and the index."""
    out = set()
    hashed = [(i, D.word_hashes(s or "")) for i, s in items]
    for d, t in docs:
        x = D.word_hashes(t or "").tolist()
        at = {}
        for k in range(len(x) - 2):
            at.setdefault(tuple(x[k:k + 3]), []).append(k)
        for i, w in hashed:
            offsets = {k - j for j in range(len(w) - 2) for k in at.get(tuple(w[j:j + 3].tolist()), ())}
            for k in offsets:
                a, b = max(0, -k), min(len(w), len(x) - k)
                u, v = D.stretch(w[a:b] == np.array(x[a + k:b + k], np.uint64))
                if v - u >= D.MIN_WORDS:
                    out.add((d, i))
    return out


def test_query_against_all_offsets(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontaminate_spaced_seeds"][0](spark, sf).collect()}
    assert got == holders(docs, items) and got
