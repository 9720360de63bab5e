"""SimHash near-dedup with vantage-point trees.

1. A text's fingerprint: A-Z lower-cased, words between white space, 3-word
   shingles with repeats, XXH64 (seed 42) of each; a bit is set where over
   half of the hashes have it.
2. Distinct fingerprints are partitioned by a vantage-point tree over the
   Hamming distance, fitted on a bounded sample: inside a node's radius goes
   to one child, the rest to the other, down to shards.  A fingerprint has
   one home shard; one that is within the bit distance of a boundary is
   also sent, as a query, to the shard beyond it (triangle bounds say
   that no other shard can hold a partner).
3. In a shard the tree goes on in memory, pruned by the same bounds; small
   leaves are compared exactly.  A leaf returns links to the smallest member
   of each linked set, never all pairs.  Where no radius parts a dense ball of
   fingerprints, they go by blocks: of one block more than bits may differ,
   one is equal in any two partners, so each block's equal values are a group
   of their own, and so on over the bits that are left.  Shards that hold
   far more homes than others are dealt out by the same blocks first (queries
   alone make a shard large only far beyond that: each level of the tree adds
   some); the many small groups that blocks make travel in buckets.
4. Links between distinct fingerprints join to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftkit.llm.common import arrow_map, column, fresh, keyed_text, pieces, small_side, written
from draftkit.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Distinct fingerprints in a shard, about; the tree is fitted on one in
#: SAMPLE_EVERY of them, and on no more than about SAMPLE_MOST.
SHARD, SAMPLE_EVERY, SAMPLE_MOST = 1 << 14, 256, 1 << 22
#: A group of more than so many times SHARD homes, or rows, goes by blocks.
MOST_HOMES, MOST_ROWS = 4, 64
#: Fingerprints that go down the tree at once: a node costs the same for few.
ROUTED = 1 << 15
#: Fingerprints in a leaf that is compared without a further split.
LEAF = 256
#: Groups of up to so many are compared side by side.
FEW = 8

_OFFSETS = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# -- fingerprints ----------------------------------------------------------

def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A text's fingerprint (UTF-8 in, unsigned 64 bits out).  Fewer words
    than a shingle: the whole sequence is one; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 14):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(starts[i:i + (1 << 14)].tolist(), ends[i:i + (1 << 14)].tolist(), strict=True)], np.uint64)
        seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
        ones += (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the unsigned bits as a bigint."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                texts = pc.cast(part.column(1), pa.binary()).to_pylist()
                fp = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(keyed_text(docs, id_col, text_col), run, "doc_id long, fp long")


# -- the tree --------------------------------------------------------------

def split(points: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """The best of a few vantage points and its radius: that which sends the
    fewest points to both sides.  None if no split is worth it."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, 5).astype(int)]:
        d = np.bitwise_count(points ^ v)
        for radius in {int(np.median(d)), int(np.median(d)) - 1}:
            inside = d <= radius
            if inside.any() and not inside.all():
                cost = (d <= radius + bits).sum() + (d + bits > radius).sum() + abs(int(inside.sum()) * 2 - len(d)) / 4
                if best is None or cost < best[0]:
                    best = (cost, v, radius)
    return best[1:] if best and best[0] < 1.9 * len(points) else None


def fit_tree(sample: np.ndarray, leaves: int, bits: int) -> list:
    """Nested [vantage point, radius, inside, outside]; a shard is its
    number.  ``leaves``: about how many."""
    least, n = max(len(sample) // max(leaves, 1), 8), [0]

    def node(points):
        got = split(points, bits) if len(points) > 1.5 * least else None
        if got is None:
            n[0] += 1
            return n[0] - 1
        v, radius = got
        inside = np.bitwise_count(points ^ v) <= radius
        return [int(v), radius, node(points[inside]), node(points[~inside])]

    return node(sample)


def routed(fp: np.ndarray, query: np.ndarray, v: np.uint64, radius: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What goes inside, then what goes outside: (fingerprints, is query).
    A home near the boundary crosses it from the inside only, as then one of
    any two partners is a home where the other one is sent."""
    d = np.bitwise_count(fp ^ v).astype(np.int64)
    inside = d <= radius
    go = np.where(query, d <= radius + bits, inside)
    yield fp[go], query[go]
    go = np.where(query, True, ~inside | (d + bits > radius)) & (d + bits > radius)
    yield fp[go], (query | inside)[go]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """The first column of batches, about ``rows`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        n += len(held[-1])
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def shards(tree, fp: np.ndarray, query: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not len(fp):
        return
    if isinstance(tree, int):
        yield tree, fp, query
        return
    sides = routed(fp, query, np.uint64(tree[0]), tree[1], bits)
    for child, (f, q) in zip(tree[2:], sides, strict=True):
        yield from shards(child, f, q, bits)


def leaf_links(homes: np.ndarray, others: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact comparison of homes with homes and with others: every linked
    fingerprint with the smallest of its set."""
    points = np.concatenate([homes, others])
    label = np.arange(len(points))
    rows = max(1, (1 << 21) // len(points))
    for i in range(0, len(homes), rows):
        near = np.bitwise_count(homes[i:i + rows, None] ^ points[None, :]) <= bits
        for r in np.flatnonzero(near.sum(axis=1) > 1):
            roots = np.unique(label[np.flatnonzero(near[r])])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    least = np.full(len(points), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, label, points)
    root = least[label]
    linked = root != points
    return points[linked], root[linked]


ALL_BITS = (1 << 64) - 1


def blocks_of(mask: int, bits: int) -> list[int]:
    """The bits of ``mask`` in one block more than bits may differ; none
    where there are too few left."""
    places = [k for k in range(64) if mask >> k & 1]
    k = bits + 1
    if len(places) < 2 * k:
        return []
    return [sum(1 << p for p in places[len(places) * j // k:len(places) * (j + 1) // k]) for j in range(k)]


def links(fp: np.ndarray, query: np.ndarray, bits: int, mask: int = ALL_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tree goes on until leaves are small; what it can't split, or
    what differs only in the bits of ``mask``, goes by blocks."""
    stack = [(fp, query, mask)]
    while stack:
        fp, query, mask = stack.pop()
        homes = fp[~query]
        if not len(homes) or len(fp) < 2:
            continue
        got = split(homes, bits) if len(homes) > LEAF and mask == ALL_BITS else None
        if got is not None:
            stack += [(f, q, mask) for f, q in routed(fp, query, *got, bits)]
        elif len(homes) > LEAF and blocks_of(mask, bits):
            for block in blocks_of(mask, bits):  # any two partners agree in one of them
                value = fp & np.uint64(block)
                order = np.argsort(value, kind="stable")
                yield from group_links(value[order], fp[order], query[order], bits, mask & ~block)
        else:
            yield leaf_links(homes, np.unique(fp[query]), bits)


def group_links(group: np.ndarray, fp: np.ndarray, query: np.ndarray, bits: int, mask: int = ALL_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of groups that lie one after the other: the small ones of all
    groups together, the others as ``links`` has them."""
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    sizes = np.diff(starts)
    small = np.repeat(sizes <= FEW, sizes)
    for step in range(1, min(FEW, len(group))):
        at = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        at = at[(np.bitwise_count(fp[at] ^ fp[at + step]) <= bits) & ~(query[at] & query[at + step])]
        if len(at):
            yield fp[at + step], fp[at]
    for i in np.flatnonzero(sizes > FEW):
        at = slice(starts[i], starts[i + 1])
        yield from links(fp[at], query[at], bits, mask)


def fingerprint_links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (bigint column ``fp``,
    written already) that join all pairs within ``bits`` differing bits,
    directly or over others that are that near."""
    n = prints.count()
    every = max(SAMPLE_EVERY, n // SAMPLE_MOST)
    leaves = -(-n // SHARD)
    sample = np.zeros(0, np.int64)
    if leaves > 1:
        sample = np.sort(np.array([r.fp for r in prints.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").collect()], np.int64))
    tree = fit_tree(sample.view(np.uint64), leaves, bits)

    def route(batches):
        for fp in gathered(batches, ROUTED):
            got = [*shards(tree, fp.view(np.uint64), np.zeros(len(fp), bool), bits)]
            shard, f, q = np.repeat([g[0] for g in got], [len(g[1]) for g in got]), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
            yield from pieces(pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(f), -1)), pa.array(f.view(np.int64)), pa.array(q)], GROUP), ROUTED)

    def by_blocks(batches):
        """Rows of a group that is too large -> a row in the group of each of
        their blocks."""
        for batch in batches:
            group, mask, fp, q = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp, mask, group = fp.view(np.uint64), mask.view(np.uint64), group.view(np.uint64)
            for m in np.unique(mask).tolist():
                at = mask == m
                for j, block in enumerate(blocks_of(m, bits)):
                    value = ((fp[at] & np.uint64(block)) ^ (group[at] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(j)) * np.uint64(0xBF58476D1CE4E5B9)
                    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    yield pa.RecordBatch.from_arrays([pa.array((value ^ (value >> np.uint64(29))).view(np.int64)), pa.array(np.full(at.sum(), m & ~block, np.uint64).view(np.int64)),
                                                      pa.array(fp[at].view(np.int64)), pa.array(q[at])], GROUP)

    def compare(key, table):
        group, fp, q = table.column("grp").to_numpy(), table.column("fp").to_numpy().view(np.uint64), table.column("query").to_numpy()
        order = np.lexsort((fp, group))  # the same links whatever the order of arrival
        got = [*group_links(group[order], fp[order], q[order], bits, key[1].as_py() & ALL_BITS)]
        a, b = (np.concatenate([g[i] for g in got]).view(np.int64) if got else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    def compared(groups):
        return groups.withColumn("bucket", F.pmod("grp", F.lit(buckets))).groupBy("bucket", "mask").applyInArrow(compare, "a long, b long")

    dealt = arrow_map(prints.select("fp"), route, _GROUP_SCHEMA)
    out, mask, buckets = None, ALL_BITS, max(len(sample), 1)  # a shard is a bucket
    while leaves > 1 and blocks_of(mask, bits):  # the bits that are left get fewer each time
        dealt = written(dealt, "simhash-dealt")
        sizes = dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("query")).alias("homes"))
        large = written(sizes.where((F.col("homes") > MOST_HOMES * SHARD) | (F.col("n") > MOST_ROWS * SHARD)).select("grp", "n"), "simhash-large")
        rows = large.agg(F.sum("n")).first()[0]
        if not rows:
            break
        large = small_side(large.select("grp"))
        done = compared(dealt.join(large, "grp", "left_anti"))
        out = done if out is None else out.unionByName(done)
        dealt = arrow_map(dealt.join(large, "grp", "left_semi").select(*GROUP), by_blocks, _GROUP_SCHEMA)
        mask &= ~max(blocks_of(mask, bits), key=int.bit_count)
        buckets = -(-rows // SHARD)
    last = compared(dealt)
    return last if out is None else out.unionByName(last)


#: A group of fingerprints that are compared with each other; mask: the bits
#: in which they may differ.
GROUP = ["grp", "mask", "fp", "query"]
_GROUP_SCHEMA = "grp long, mask long, fp long, query boolean"


# -- the operator ----------------------------------------------------------

def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS,
                shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable over fingerprints that
    differ in at most ``bits`` bits, its own included), links (how many other
    fingerprints join it to its component: 0 for none).

    Null and empty texts, and texts of white space only, have fingerprint
    zero and link like any other.  Repeated rows give repeated rows; rows of
    one fingerprint are in one component, whatever their order.  Null
    doc_ids take part, but name no component unless all of it has none.  An
    empty table gives no rows.  Other columns are not read.
    """
    narrow = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    # a row per distinct fingerprint, combined before the shuffle
    prints = written(narrow.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    linked = written(components(fingerprint_links(prints, bits)), "simhash-components")
    member = linked.select(F.col("node").alias("fp"), "root").unionByName(linked.select(F.col("root").alias("fp"), "root").distinct())
    member = written(member.join(prints, "fp"), "simhash-members")
    best = member.groupBy("root").agg(F.min("first").alias("component_id"), (F.count(F.lit(1)) - 1).alias("links"))
    member = small_side(written(member.select("fp", "root").join(best, "root").select("fp", "component_id", "links"), "simhash-best"))
    alone = prints.join(member, "fp", "left_anti").select("fp", F.col("first").alias("component_id"), F.lit(0).cast("bigint").alias("links"))
    return (narrow.join(member.unionByName(alone), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS,
              shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id.
    A document is its doc_id here: rows that repeat one stay or go
    together, and rows without one stay."""
    key = fresh(docs, "_drop")
    out = near_groups(docs, id_col, text_col, bits, shingle, seed)
    gone = written(out.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "simhash-drop")
    gone = small_side(gone)
    return docs.join(gone, column(docs, id_col) == gone[key], "left_anti")
