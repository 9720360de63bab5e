import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from draftkit.llm.merkle import fold, manifest
from draftkit.llm.queries import QUERIES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes, arity):
    """All levels of the tree over a list of digests."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + arity])) for k in range(0, len(out[-1]), arity)])
    return out


def path(levels, at, arity):
    out = []
    for nodes in levels[:-1]:
        run = at // arity * arity
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + arity])))
        at //= arity
    return out


def brute(rows, arity):
    """(doc_id, source, lang, n_chars, text) rows -> doc_id, source, leaf, subroot, root, proof."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], h("".join(framed(r[k]) for k in (0, 1, 2, 3, 4)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels_of([d for _, d in groups[g]], arity)
    top = levels_of([trees[g][-1][0] for g in order], arity) if order else []
    return [(i, g, leaf, trees[g][-1][0], top[-1][0], path(trees[g], k, arity) + path(top, n, arity))
            for n, g in enumerate(order) for k, (i, leaf) in enumerate(groups[g])]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, _g int, root string"


def rows_of(n, sources):
    return [(k, sources[k % len(sources)] if k % 3 else sources[0], "en", 2, f"Text {k}") for k in range(n)]


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_trees_and_proofs(spark, arity):
    rows = rows_of(75, ["hot", "b", None, "é", "Z", "a"]) + [(7, "lone", None, None, None), (None, "hot", "en", 0, ""), (None, None, None, None, None),
                                                       (3, "b", "x", 1, "again"), (3, "b", "x", 1, "again"), (99, "", "x", 1, "y" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], SCHEMA)
    out = manifest(df, arity=arity).withColumn("folded", fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in out)
    got = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in out]
    assert sorted(got, key=repr) == sorted(brute(rows, arity), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "x")], rows_of(16, ["a"]), rows_of(17, ["a"])])
def test_small_trees(spark, rows):
    got = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in manifest(spark.createDataFrame([(*r, 1, 2, "r") for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 16), key=repr)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {}
    text = {r[0]: r for r in rows}
    for i, _, leaf, subroot, root, proof in brute(rows, 16):
        r = text[i]
        now = leaf
        if zlib.crc32(str(i).encode()) % 5 == 0:
            now = h("".join(map(framed, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))))
        for left, right in proof:
            now = h(left + now + right)
        want[i] = (leaf, subroot, root, h("".join(a + b for a, b in proof)), now, now == root)
    got = QUERIES["op13_merkle_manifest"][0](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert {r.verified for r in got} == {True, False}
