"""Benchmark decontamination with spaced-seed hashing.

1. Texts become words: lower-cased, cut at white space, stripped of
   punctuation (words of nothing else fall away), hashed to 64 bits.
2. Every fixed mask is laid over every position; the words under its ones
   give a seed hash, those under its zeros are ignored, so a substituted
   word there does no harm.  Seed hashes of the benchmark and of the
   documents are joined: a bit table passes few positions, a sorted search
   finds the exact hits.
3. Around a hit the benchmark item is laid on the document at the hit's
   offset, and the longest stretch with at least 80 % equal words is taken.
   It counts from MIN_WORDS words.  An item of fewer words counts where all
   of it stands word for word.  Equal words are counted for all hits of a
   batch at once, and most offsets fall by that count: an opening that
   thousands of items share costs a document some array operations.

The benchmark is hashed once and goes to the tasks in blocks of bounded size.
Where it takes several, the documents are hashed once, too, into a table that
each block reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftkit.functions.joins import checked_broadcast_join
from draftkit.llm.common import MEMORY, arrow_map, column, fresh, keyed_text, pieces, small_batches, written

#: With three substitutions in any 15 words, two in 13, or four in 20, at
#: least one of these hits (tests try all cases).
MASKS = ("11011", "110011", "1101011")
MIN_WORDS, SIMILARITY = 13, 0.8
#: Words that are compared at a time.
_CELLS = 1 << 20
#: Words of the benchmark in one block (8 bytes each, and 16 for each seed).
BLOCK_WORDS = 1 << 19
_TABLE_BITS = 22

_EDGE = re.compile(r"[\W_]+")


class Words(dict):
    """word -> hash; 0 for words of punctuation only."""

    def __missing__(self, word: str) -> int:
        bare = _EDGE.sub("", word)
        h = xxhash.xxh64_intdigest(bare) or 1 if bare else 0
        if len(self) > MEMORY:
            self.clear()
        self[word] = h
        return h


@lru_cache(maxsize=1)
def _words() -> Words:
    return Words()


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def _factors(mask: str) -> list[tuple[int, np.uint64]]:
    """Offsets of a mask's ones, with an odd factor for each."""
    return [(i, np.uint64(xxhash.xxh64_intdigest(f"{mask}:{i}") | 1)) for i, c in enumerate(mask) if c == "1"]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash of every position that the mask fits."""
    n = len(words) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i, f in _factors(mask):
        if n > 0:
            x = words[i:i + n] * f
            out += x ^ (x >> np.uint64(29))
    return out


def stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest stretch with at least SIMILARITY equal
    entries (the first of several)."""
    up = np.concatenate([[0], np.cumsum(np.where(equal, 1.0, 0.0) - SIMILARITY)]) + np.arange(len(equal) + 1) * 1e-12
    best, low, j = (0, 0), np.minimum.accumulate(up), 0
    high = np.maximum.accumulate(up[::-1])[::-1]
    for i in range(len(low)):  # two pointers over prefix minima and suffix maxima
        while j < len(up) and high[j] >= low[i]:
            j += 1
        if j - 1 - i > best[1] - best[0]:
            best = (i, j - 1)
    return best


class Index:
    """A block of the benchmark: items' words and their sorted seeds."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.words = [np.frombuffer(w, np.uint64) for _, w in items]
        # items shorter than the longest mask are looked up whole as well
        short = {len(w) for w in self.words if 0 < len(w) < max(map(len, MASKS))}
        self.masks = [*MASKS, *("1" * n for n in sorted(short))]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.tables = []
        for m in self.masks:
            h = [seeds(w, m) for w in self.words]
            item = np.repeat(np.arange(len(h)), [len(x) for x in h])
            pos = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
            h = np.concatenate(h) if h else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _TABLE_BITS, bool)
            bits[h >> np.uint64(64 - _TABLE_BITS)] = True
            self.tables.append((m, h[order], item[order], pos[order], bits))

    def _close(self, t, i, d, flat, text_size, text_start) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, item, offset, equal words) of the offsets with enough equal
        words, of those given."""
        a = np.maximum(0, -d)
        n = np.minimum(self.size[i], text_size[t] - d) - a
        need = np.where(self.size[i] >= MIN_WORDS, -int(-MIN_WORDS * SIMILARITY // 1), self.size[i])
        u = 0
        total = np.cumsum(n)
        while u < len(n):  # blocks of about _CELLS words
            v = max(u + 1, int(np.searchsorted(total, (total[u - 1] if u else 0) + _CELLS, "right")))
            size = n[u:v]
            first = np.cumsum(size) - size
            k = np.arange(size.sum()) - np.repeat(first - a[u:v], size)
            equal = self.flat[k + np.repeat(self.start[i[u:v]], size)] == flat[k + np.repeat((text_start[t] + d)[u:v], size)]
            for j in np.flatnonzero(np.add.reduceat(equal.astype(np.int64), first) >= need[u:v]).tolist():
                yield int(t[u + j]), int(i[u + j]), int(d[u + j]), equal[first[j]:first[j] + size[j]]
            u = v

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, words, equal words, start in the text, start in the
        item) of the best overlap of every text and item that have one."""
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        found = []
        for m, h, item, pos, bits in self.tables:
            s = seeds(flat, m)
            at = np.flatnonzero(bits[s >> np.uint64(64 - _TABLE_BITS)])
            left, right = np.searchsorted(h, s[at], "left"), np.searchsorted(h, s[at], "right")
            text = np.searchsorted(ends, at, "right")
            ok = (right > left) & (at + len(m) <= ends[np.minimum(text, len(ends) - 1)] if len(ends) else right > left)
            at, left, n, text = at[ok], left[ok], (right - left)[ok], text[ok]
            k = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            t = np.repeat(text, n)
            diagonal = np.repeat(at, n) - (ends - size)[t] - pos[k]
            found.append(np.stack([t, item[k], diagonal]))
        best: dict = {}
        t, i, d = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        low = -int(self.size.max(initial=0))
        wide = int(size.max(initial=0)) - low + 1
        once = np.unique((t * max(len(self.ids), 1) + i) * wide + (d - low))
        pair, d = np.divmod(once, wide)
        t, i = np.divmod(pair, max(len(self.ids), 1))
        for t, i, d, equal in self._close(t, i, d + low, flat, size, ends - size):
            a, length = max(0, -d), len(self.words[i])
            u, v = stretch(equal)
            got = (v - u, int(equal[u:v].sum()), a + d + u, a + u)
            enough = got[0] >= MIN_WORDS if length >= MIN_WORDS else got[1] == length
            if enough and got[:2] > best.get((t, i), (0, 0)):
                best[t, i] = got
        for (t, i), got in best.items():
            yield (t, i, *got)


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    """(key, text) -> (key, words, n): the texts as hashed words."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                w = [word_hashes(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in w], pa.binary()), pa.array([len(x) for x in w], pa.int64())],
                                                 ["key", "words", "n"])

    return arrow_map(rows, run, f"key {key}, words binary, n long")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, min_item: int) -> list[tuple]:
    """The benchmark's items as hashed words, broadcast in blocks of about
    BLOCK_WORDS; a block comes to the driver by itself."""
    items = written(_hashed(keyed_text(benchmark, id_col, text_col), "long").where(F.col("n") >= max(min_item, 1)), "benchmark-words")
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_WORDS)
    sc, out = benchmark.sparkSession.sparkContext, []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).select("key", "words")
        out.append(sc.broadcast(tuple(sorted(((r.key, bytes(r.words)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))))
    return out


@lru_cache(maxsize=2)
def _index(shared) -> Index:
    """One per worker and block."""
    return Index(list(shared.value))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text", min_item: int = 1) -> DataFrame:
    """One row per document row and benchmark item that overlap: doc_id,
    item_id, n_words (of the overlap), n_equal, similarity, doc_start,
    item_start (in words).  Clean documents have no row.

    ``min_item`` leaves out items of fewer words; by default every item with
    a word is searched for.  Of several overlaps of a document with an item
    the longest is told, of equally long ones that with most equal words, of
    those the first offset.  Null texts are empty and overlap nothing;
    repeated rows on either side give repeated rows; null ids stay null;
    empty tables give no rows.  Texts are searched whole.
    """
    rows = keyed_text(docs, id_col, text_col)
    blocks = _blocks(benchmark, item_id_col, item_text_col, min_item)
    hashed = len(blocks) > 1
    if hashed:
        rows = written(_hashed(rows, "long").select("key", "words"), "document-words")

    def run_with(shared):
        def run(batches):
            index = _index(shared)
            for batch in batches:
                for part in pieces(batch):
                    texts = part.column(1).to_pylist()
                    found = [*index.hits([np.frombuffer(t, np.uint64) if hashed else word_hashes(t) for t in texts])]
                    ids = part.column(0).to_pylist()
                    cols = [[ids[r[0]] for r in found], [index.ids[r[1]] for r in found], *([r[k] for r in found] for k in (2, 3)),
                            [r[3] / r[2] for r in found], *([r[k] for r in found] for k in (4, 5))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(cols)], NAMES)
        return run

    schema = ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n in NAMES)
    out = None
    for shared in blocks:
        got = arrow_map(rows, run_with(shared), schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


NAMES = ["doc_id", "item_id", "n_words", "n_equal", "similarity", "doc_start", "item_start"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                      min_item: int = 1) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap no
    benchmark item.  A row's text alone decides, so with one block there is
    no shuffle; with several, the texts that overlap are found once by their
    md5 and joined away.  Null and empty texts stay; rows of one text stay or
    go together; an empty table or benchmark changes nothing."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_id_col, item_text_col, min_item)
    text = column(docs, text_col)
    if len(blocks) == 1:
        return docs.where(_clean(blocks[0], False)(text))
    if not blocks:
        return docs
    rows = written(_hashed(docs.select(F.md5(text).alias("key"), F.coalesce(text, F.lit("")).alias("text")), "string").select("key", "words"), "document-words")
    bad = None
    for shared in blocks:
        got = rows.where(~_clean(shared, True)(F.col("words"))).select("key")
        bad = got if bad is None else bad.unionByName(got)
    name = fresh(docs, "_md5")
    bad = written(bad.distinct().withColumnRenamed("key", name), "contaminated")
    return checked_broadcast_join(docs.withColumn(name, F.md5(text)), bad, name, "left_anti").drop(name)


def _clean(shared, hashed: bool):
    def clean(texts: pd.Series) -> pd.Series:
        index = _index(shared)
        out = np.ones(len(texts), bool)
        for a in range(0, len(texts), 256):
            for hit in index.hits([np.frombuffer(t, np.uint64) if hashed else word_hashes(t or "") for t in texts.iloc[a:a + 256]]):
                out[a + hit[0]] = False
        return pd.Series(out)

    return F.pandas_udf(clean, "boolean")
