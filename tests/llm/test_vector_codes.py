import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from draftkit.llm.queries import QUERIES
from draftkit.llm.vector_codes import books_digest, compress, nearest, with_label_error


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, label, vector) rows -> codes and codebooks, one loop a step."""
    kept = sorted(((i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], [[] for _ in range(parts)]
    w = len(kept[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            by = {}
            for c in cut:
                by.setdefault(near(p, c[p])[1], []).append(c[p])
            new.append([[sum(x) // len(by[k]) for x in zip(*by[k])] if k in by else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for (i, lab, _), c in zip(kept, cut):
        got = [near(p, c[p]) for p in range(parts)]
        out.append((i, lab, [k for _, k in got], sum(d for d, _ in got)))
    return out, books


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.data())
def test_trie_finds_the_nearest_entry(width, data):
    row = st.lists(st.integers(-3, 3), min_size=width, max_size=width)
    rows, book = data.draw(st.lists(row, min_size=1, max_size=40)), data.draw(st.lists(row, min_size=1, max_size=6))
    if data.draw(st.booleans()):
        rows = sorted(rows)
    code, dist = nearest(np.array(rows, np.int64), np.array(book, np.int64))
    want = [min((sum((a - b) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(book)) for r in rows]
    assert list(zip(dist.tolist(), code.tolist())) == want


def same(spark, rows, parts=2, entries=3, rounds=4):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, code int, _label string")
    codes, books = compress(df, parts=parts, entries=entries, rounds=rounds)
    got = [(r.vec_id, r.label, r.code, r.error, r.label_error) for r in with_label_error(codes).collect()]
    want, want_books = plain_codes(rows, parts, entries, rounds)
    total = {}
    for _, lab, _, e in want:
        total[lab] = total.get(lab, 0) + e
    assert sorted(got, key=repr) == sorted(((i, lab, c, e, total[lab]) for i, lab, c, e in want), key=repr)
    assert books.tolist() == want_books


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    same(spark, [(5, 1, [0.1, 0.2, -0.3, 0.0]), (1, None, [0.1, 0.2, -0.3, 0.5]), (2, None, None), (3, 1, [0.1, None, 0.0, 0.0]), (4, 2, [nan, 0.0, 0.0, 0.0]),
                 (6, 2, [0.0, inf, 0.0, 0.0]), (7, 1, []), (8, 3, [0.0, 0.0, 0.0, 0.0]), (8, 3, [0.0, 0.0, 0.0, 0.0]), (9, 3, [-0.00001, 0.2, 7.0, -7.0]),
                 (None, 3, [1.0, 1.0, 1.0, 1.0]), (12, None, [0.1, 0.2, -0.3, 0.5])])


def test_fewer_rows_than_entries_and_all_dropped(spark):
    same(spark, [(2, 0, [1.5, -2.0])], entries=16)
    same(spark, [(2, 0, None), (3, 0, [float("nan"), 1.0])])
    same(spark, [])


def test_one_vector_holds_a_third_of_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, [0.25, 0.5, 0.75, 1.0] if k % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for k in range(600)]
    same(spark, rows, entries=5)


def test_unfit_vectors_fail_by_name(spark):
    for rows in ([(1, 0, [1.0, 2.0, 3.0])], [(1, 0, [1.0, 2.0]), (2, 0, [1.0])], [(1, 0, [1.0, 1e9])]):
        with pytest.raises(Exception, match="vector"):
            df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
            compress(df, parts=2)[0].collect()


def test_query_against_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, books = plain_codes(rows, 8, 16, 6)
    got = QUERIES["op11_vector_code_trie"][0](spark, sf).collect()
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()}
    assert books_digest(np.array(books)) == got[0].codebooks_sha256
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((i, "".join(f"{k:02x}" for k in c), e) for i, _, c, e in want)
