import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from draftkit.llm import substrings
from draftkit.llm.queries import QUERIES
from draftkit.llm.substrings import Automaton, bounds, cut, remove_repeats, spaced, word_hashes

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out


def brute(rows, length):
    docs = [(i, words_of(t)) for i, t in rows]
    seen = Counter(tuple(w[k:k + length]) for _, w in docs for k in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(df, length):
    rows = remove_repeats(df, length=length).collect()
    for r in rows:
        assert r.n_removed == sum(s["to"] - s["from"] for s in r.spans or ())
        assert all(a["to"] < b["from"] for a, b in zip(r.spans or (), (r.spans or ())[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), st.integers(1, 2)), min_size=1, max_size=6), st.integers(1, 5))
def test_automaton_knows_what_occurs_twice(sequences, least):
    made = Automaton()
    for words, times in sequences:
        made.add(words, times)
    made.close()
    made = Automaton.unpack(made.pack())
    seen = Counter()
    for words, times in sequences:
        for k in range(len(words) - least + 1):
            seen[tuple(words[k:k + least])] += times
    for words in [*(w for w, _ in sequences), [b"a", b"z", b"a", b"b", b"a"]]:
        want = {j for k in range(len(words) - least + 1) if seen[tuple(words[k:k + least])] > 1 for j in range(k, k + least)}
        assert {j for a, b in made.spans(words, least) for j in range(a, b)} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["x", "yy", "zé", "w" * 200]), max_size=60), min_size=1, max_size=4), st.integers(0, 2))
def test_every_window_is_in_one_piece_and_equal_windows_share_a_key(texts, order):
    length = 14
    raw = [" ".join(t).encode() for t in texts]
    buffer = b" ".join(t for t in raw if t)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts, ends = bounds(buffer)
    h = word_hashes(buffer, starts, ends)
    flat = [w for t in texts for w in t]
    assert len(set(h.tolist())) == len(set(flat))
    start, m, key, times, _ = cut(h, text, length, order)
    got = {s + k: x for s, n, x in zip(start.tolist(), m.tolist(), key.tolist()) for k in range(n)}
    assert sum(m.tolist()) == len(got)
    want = [k for k in range(len(flat) - length + 1) if text[k] == text[k + length - 1]]
    assert sorted(got) == want
    inside = {k: n for k, n in zip(start.tolist(), times.tolist())}
    for s, n in zip(start.tolist(), m.tolist()):
        if len({tuple(flat[s + k:s + k + length]) for k in range(n)}) < n:
            assert inside[s] > 1
    by = {}
    for k in want:
        assert by.setdefault(tuple(flat[k:k + length]), got[k]) == got[k]


def random_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 40, k)]
    shared, line = word(45), word(16)
    rows = []
    for i in range(n):
        t = word(int(rng.integers(0, 90)))
        if i % 3 == 0:
            t[10:10] = shared[int(rng.integers(0, 8)):]
        if i % 4 == 0:
            t = t + line * int(rng.integers(1, 5))
        if i % 7 == 0 and rows:
            t = words_of(rows[-1][1])
            t[len(t) // 2:len(t) // 2 + 1] = ["changed"]
        rows.append((i, (" ", "\n", "\t ", "\x0b")[i % 4].join(t)))
    return rows


EDGES = [(100, None), (101, ""), (102, " \t\n "), (103, "x " * 5000), (104, "x " * 60), (None, "tail " * 34), (None, None), (105, "Ünï code " * 40),
         (106, "same text " * 20), (106, "same text " * 20), (107, "A b " * 20), (108, "a b " * 20), (109, "w" * 3000 + " " + "q " * 36)]


@pytest.mark.parametrize("limits", [(1 << 16, 1 << 16), (300, 150), (300, 1)])
def test_against_all_windows(spark, monkeypatch, limits):
    """With small limits keys are cut again, at last into single windows."""
    monkeypatch.setattr(substrings, "SHARD_WORDS", limits[0])
    monkeypatch.setattr(substrings, "KEY_WORDS", limits[1])
    rows = random_rows(3) + EDGES
    df = spark.createDataFrame([(*r, 1, "s", "t") for r in rows], "doc_id long, text string, a int, spans string, key string")
    assert found(df, 35) == brute(rows, 35)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("draftkit.functions.joins.measured_bytes", lambda df: 1 << 60)
    rows = random_rows(4)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 20) == brute(rows, 20)


def test_one_group_of_copies_holds_a_third_of_all_rows(spark):
    rows = random_rows(5, 40) + [(1000 + k, "copy " + " ".join(f"c{j}" for j in range(50))) for k in range(40)] + [(5000, "again " * 60)] * 30
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 35) == brute(rows, 35)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string"), 35) == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op12_substring_suffix_automata"][0](spark, sf).collect()), key=repr)
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 35)]
    assert got == sorted(want, key=repr)
    assert any(r[2] for r in got) and spaced(b" a\t b ") == b"a b"
