import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import GroupedData

from draftkit.llm import simhash as S
from draftkit.llm.components import components
from draftkit.llm.queries import QUERIES


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=2):
    """fp -> smallest fp reachable."""
    fps = sorted(set(prints))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for f in fps:
        for g in a[np.bitwise_count(a ^ np.uint64(f)) <= bits].tolist():
            x, y = find(f), find(g)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_known_hash(spark):
    t = "Á b\x0bC d\n e\x85f g "
    assert S.fingerprint(t.encode()) == slow_print(t)
    one = spark.createDataFrame([("a b",)], "t string").selectExpr("xxhash64(t) h").first().h
    assert S.fingerprint(b" A\tB") == one % 2**64  # one shingle: its own hash


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x0c\r\x1c\x85\xa0", max_size=60))
def test_fingerprints(t):
    assert S.fingerprint(t.encode()) == slow_print(t)


def clustered(n, seed, flips=3):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        f = rng.choice(out[-50:] if rng.random() < .5 else out)
        for _ in range(rng.randint(1, flips)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_every_link(seed):
    fps = clustered(3000, seed)
    arr = np.array(fps, np.uint64)
    tree = S.fit_tree(arr[::7], 9, 2)
    assert not isinstance(tree, int)
    got, homes = {}, 0
    for _, f, q in S.shards(tree, arr, np.zeros(len(arr), bool), 2):
        homes += int((~q).sum())
        for a, b in S.links(f, q, 2):
            for x, y in zip(a.tolist(), b.tolist()):
                got.setdefault(x, set()).add(y)
    assert homes == len(fps)  # one home each
    want = brute_components(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, ys in got.items():
        for y in ys:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == want


def test_dense_cluster():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)}), np.uint64)
    edges = [(a, b) for a, b in S.links(fps, np.zeros(len(fps), bool), 2)]
    assert sum(len(a) for a, _ in edges) < 40 * len(fps)  # far from all pairs


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (200, 150), (150, 300), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 200: 150, 300: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (3, ""), (9, " \n"), (8, "same text here now"), (2, "Same  TEXT here\tnow"), (2, "Same  TEXT here\tnow"), (4, long), (6, long + " x"), (None, "alone words only"), (7, "b")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = S.near_groups(df).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=repr) == sorted(((i, f"{slow_print(t):016x}") for i, t in rows), key=repr)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp == {5: 3, 3: 3, 9: 3, 8: 2, 2: 2, 4: 4, 6: 4, None: None, 7: 7}
    out = S.drop_near(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([3, 2, 2, 4, None, 7], key=repr)
    assert S.near_groups(df.where("false")).count() == 0


@pytest.mark.parametrize("shard", [S.SHARD, 64])
def test_query_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "SAMPLE_EVERY", 2)
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: S.fingerprint(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    root, least = brute_components(rows.values()), {}
    for i, f in rows.items():
        least[root[f]] = min(least.get(root[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_vantage_point"][0](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in rows.items()}


def ball(n, flips, seed):
    """Fingerprints within a few flips of one, and some anywhere."""
    rng = np.random.default_rng(seed)
    base = np.uint64(rng.integers(0, 1 << 63))
    out = np.full(n, base)
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate([out, rng.integers(0, 1 << 63, n // 10).astype(np.uint64)]))


def fast_components(fps, bits=2):
    """fp -> smallest fp reachable: the partners of every fingerprint are
    found among all of them by turning its bits over."""
    at = {f: k for k, f in enumerate(fps.tolist())}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    turns = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    for t in turns:
        other = fps ^ np.uint64(t)
        place = np.searchsorted(fps, other)
        hit = np.flatnonzero(fps[np.minimum(place, len(fps) - 1)] == other)
        for x, y in zip(hit.tolist(), place[hit].tolist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    return {f: int(fps[find(k)]) for f, k in at.items()}


def test_a_dense_ball_is_not_quadratic():
    fps = ball(50_000, 5, 3)
    found, cells = [], 0
    plain = S.leaf_links

    def counted(homes, others, bits):
        nonlocal cells
        cells += len(homes) * (len(homes) + len(others))
        return plain(homes, others, bits)

    S.leaf_links = counted
    try:
        for a, b in S.links(fps, np.zeros(len(fps), bool), 2):
            found += zip(a.tolist(), b.tolist())
    finally:
        S.leaf_links = plain
    assert cells < len(fps) ** 2 / 10 and len(found) < 40 * len(fps)
    root = {f: f for f in fps.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in found:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in root} == fast_components(fps)


def test_large_shards_are_dealt_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 100)
    monkeypatch.setattr(S, "SAMPLE_EVERY", 4)
    fps = ball(4000, 4, 8)
    df = spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in components(S.fingerprint_links(df)).collect()}
    want = fast_components(fps)
    sets = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
    everyone = {f: got.get(f, f) for f in want}
    assert sets(everyone) == sets(want)


def partition(edges, nodes):
    """node -> the smallest node reachable over the edges."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in edges:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("dense", [False, True])
def test_few_groups_however_deep_the_tree(spark, monkeypatch, dense):
    """Queries are most of the rows here.  They send no shard to the blocks,
    and what goes there anyway is not compared one small group at a time."""
    monkeypatch.setattr(S, "SHARD", 16)
    monkeypatch.setattr(S, "SAMPLE_EVERY", 2)
    fps = ball(1000, 4, 8) if dense else np.array(clustered(2000, 11), np.uint64)
    df = spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in S.fingerprint_links(df).collect()]
    assert partition(found, fps.tolist()) == fast_components(fps)
    plain = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: plain(self, lambda key, rows: pa.table({"a": [key[0].as_py()], "b": [rows.num_rows]}), schema))
    rows = [r.b for r in S.fingerprint_links(df).collect()]
    assert sum(rows) > 2 * len(fps)
    assert len(rows) < len(fps) / 2


def test_groups_side_by_side():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 20, 300)
    group = np.repeat(np.arange(300), sizes)
    base = np.repeat(rng.integers(0, 1 << 63, 300).astype(np.uint64), sizes)
    fp = base ^ rng.integers(0, 256, len(group)).astype(np.uint64)
    query = rng.random(len(group)) < .5
    found = [e for a, b in S.group_links(group, fp, query, 2) for e in zip(a.tolist(), b.tolist())]
    near = (np.bitwise_count(fp[:, None] ^ fp) <= 2) & (group[:, None] == group) & ~(query[:, None] & query)
    pairs = [(int(fp[x]), int(fp[y])) for x, y in zip(*np.nonzero(near))]
    assert partition(found, set(fp.tolist())) == partition(pairs, set(fp.tolist()))
