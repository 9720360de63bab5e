import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from draftkit.llm.exact_dedup import decode_filter, drop_exact, encode_filter, exact_groups, merge_sorted
from draftkit.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**60 - 1), min_size=1, max_size=200), st.lists(st.integers(0, 2**60 - 1), min_size=1, max_size=50))
def test_filters_round_trip_and_merge(a, b):
    def make(xs):
        low, c = np.unique(np.array(xs, np.uint64), return_counts=True)
        return decode_filter(encode_filter(low, c, 4), 4)

    (la, ca), (lb, cb) = make(a + a[:3]), make(b + a[:1])
    low, c = merge_sorted([la, lb], [ca, cb])
    want, n = np.unique(np.array(a + a[:3] + b + a[:1], np.uint64), return_counts=True)
    assert (low == want).all() and (c == n).all()


def brute(rows):
    norm = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))) for i, t in rows]
    keep, size = {}, {}
    for i, t in norm:
        keep[t] = max([x for x in (keep.get(t), i) if x is not None], default=None)
        size[t] = size.get(t, 0) + 1
    return sorted(((i, keep[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=repr)


ROWS = [(1, "Ab"), (2, "aB"), (3, "Äb"), (4, "äb"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (9, "one"), (9, "one"),
        (None, "q"), (11, "Q"), (12, " ab")]


def test_edge_rows(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, fp int, _norm int")
    got = exact_groups(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ROWS)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})  # one of each group
    out = drop_exact(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(2, "aB"), (3, "Äb"), (4, "äb"), (6, ""), (8, "X" * 300_000), (9, "one"), (11, "Q"), (12, " ab")], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(df).count() == 0 and drop_exact(df).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op7_exact_dedup_quotient_filter"][0](spark, sf).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
