"""Repeated passages removed with suffix automata of reference shards.

A window is LENGTH consecutive words of one text.  A window that starts
anywhere else, too, goes with all its words.

1. Every window has a key, the least hash of the GRAM-word sequences in it.
   Consecutive windows of one key make a piece; equal windows have equal
   keys, wherever they stand, so repeats are only looked for under one key.
   Tasks write where each piece stands, with two hashes, not its text.
2. Keys whose sequence occurs once are done with.  Of the other keys' pieces each
   distinct one is fetched once, with the number of its occurrences.  These
   are the reference; its keys are dealt to shards of bounded size.
3. A shard's suffix automaton holds all its pieces; a state knows how often
   its sequences occur.  The automata are broadcast to the tasks where they
   measure few bytes, else each joins its shard's chunks of pieces.
4. The pieces stream through their shard's automaton.  Their matching
   statistics say for each word how long a sequence ends there that occurs
   twice or more; from LENGTH words on, it counts.  Maximal spans come back
   to the texts by the pieces' hashes.

A key with more reference words than a shard holds (say, what stands next to
a passage that many texts share) is cut again by other hashes, and at last
into single windows, so no shard grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftkit.functions.joins import checked_broadcast_join
from draftkit.llm.common import arrow_map, column, discard, pieces, written, written_at

LENGTH, GRAM = 35, 12
#: Windows of a piece at most (longer runs of one key are cut).
PIECE = 256
#: Words of a shard on average, and of one key at most.
SHARD_WORDS, KEY_WORDS = 1 << 16, 1 << 16
#: Pieces of a chunk that streams.
CHUNK = 512
#: Compression of automata and chunks, which are written and shuffled once.
PACKED = 9
#: Cuts by hash order before a key's windows are taken one by one.
ORDERS = 2

_SLAB = 1 << 20


# -- words and keys -----------------------------------------------------------

def spaced(text: bytes) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join(text.split())


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    t = np.random.default_rng(20).integers(1, 1 << 63, (64, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    t[:, 32] = 0
    return t


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a spaced text."""
    gaps = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    if not buffer:
        return gaps, gaps
    return np.concatenate([[0], gaps + 1]), np.append(gaps, len(buffer))


def word_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random value for every byte
    at its place in the word."""
    table, data, out = _byte_values(), np.frombuffer(buffer, np.uint8), np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # slabs bound the memory for long texts
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SLAB)))
        s, e = starts[a:b], ends[a:b]
        part = data[s[0]:e[-1]]
        place = np.arange(len(part)) - np.repeat(s - s[0], np.append(s[1:], e[-1]) - s)
        value = table[place & 63, part] * (2 * (place >> 6) + 1).astype(np.uint64)
        out[a:b] = np.add.reduceat(value, s - s[0])
        a = b
    return _mix(out)


_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))


def sequence_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words from start to end, wherever they stand."""
    n = len(words)
    up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _M, np.uint64))])
    down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _M_INVERSE, np.uint64))])
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n])])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive entries."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def cut(words: np.ndarray, text: np.ndarray, length: int, order: int) -> tuple[np.ndarray, ...]:
    """(start, windows, key, times that the key's sequence stands in it, hash)
    of the pieces of concatenated texts; ``text`` is the number of the text
    that a word belongs to."""
    n = len(words) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    whole = text[:n] == text[length - 1:]
    every = np.arange(n)
    if order < ORDERS:
        gram = min(GRAM, length)
        g = sequence_hashes(words, np.arange(len(words) - gram + 1), np.arange(gram, len(words) + 1))
        if order:
            g = _mix(g + np.uint64(order * int(_M) % 2**64))
        key = _least(g, length - gram + 1)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:n] != text[:n - 1])])
        first = np.maximum.accumulate(np.where(new, every, 0))
        new |= (every - first) % PIECE == 0
    else:
        key = sequence_hashes(words, every, every + length)
        new = np.ones(n, bool)
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    # windows over the end of a text are the last of its run
    good = np.concatenate([[0], np.cumsum(whole)])
    size = good[end] - good[start]
    start, size = start[size > 0], size[size > 0]
    if order < ORDERS and len(start):  # a window that repeats in its piece has the sequence with it each time
        span = size + length - gram
        first = np.cumsum(span) - span
        at = np.arange(span.sum()) + np.repeat(start - first, span)
        times = np.add.reduceat((g[at] == np.repeat(key[start], span)).astype(np.int64), first)
    else:
        times = np.ones(len(start), np.int64)
    return start, size, key[start].view(np.int64), times, sequence_hashes(words, start, start + size + length - 1).view(np.int64)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Spaced texts as one, and the number of words of each."""
    return b" ".join(t for t in texts if t), np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)


def _find_pieces(length: int, order: int):
    """(a, b, n, text) -> where each piece stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                buffer, size = _joined([spaced(t) for t in part.column(3).cast(pa.binary()).to_pylist()])
                starts, ends = bounds(buffer)
                text = np.repeat(np.arange(len(size)), size)
                start, m, key, times, h = cut(word_hashes(buffer, starts, ends), text, length, order)
                row = text[start] if len(start) else start
                at = start - (np.cumsum(size) - size)[row]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(rows) for k in range(3)] + [pa.array(x, pa.int64()) for x in (at, m, key, times, h)],
                    ["a", "b", "n", "start", "m", "key", "times", "hash"])
    return run


def _take_pieces(length: int):
    """(text, list of wanted pieces) -> their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 64):
                cols = [[], [], [], [], []]
                for text, wanted in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist()):
                    text = spaced(text)
                    starts, ends = bounds(text)
                    for w in wanted:
                        size = w["m"] + length - 1
                        row = (w["key"], w["hash"], w["n"], text[starts[w["start"]]:ends[w["start"] + size - 1]], size)
                        for c, x in zip(cols, row):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()).cast(pa.string() if k == 3 else pa.int64())
                                                  for k, c in enumerate(cols)], ["key", "hash", "n", "words", "size"])
    return run


# -- the automaton ------------------------------------------------------------

class Automaton:
    """Suffix automaton of weighted word sequences: ``count[s]`` is how often
    the sequences of state s occur (2 stands for more).  Most states have one
    edge, in ``word`` and ``to``; further ones are in ``more``."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.word, self.to, self.more = [-1], [-1], {}
        self.link, self.length, self.count = [-1], [0], [0]

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the sequences of q that end at p's, one word longer."""
        word, to, more, link = self.word, self.to, self.more, self.link
        c = len(link)
        word.append(word[q])
        to.append(to[q])
        if q in more:
            more[c] = dict(more[q])
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = c
            else:
                edges = more.get(p)
                if edges is None or edges.get(w) != q:
                    break
                edges[w] = c
            p = link[p]
        link[q] = c
        return c

    def add(self, words: list[bytes], times: int) -> None:
        word, to, more, link, length, count, ids = self.word, self.to, self.more, self.link, self.length, self.count, self.ids
        last = 0
        for x in words:
            w = ids.setdefault(x, len(ids))
            if word[last] == w:
                q = to[last]
            else:
                edges = more.get(last)
                q = edges.get(w, -1) if edges else -1
            if q >= 0:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                new, p = len(link), last
                word.append(-1)
                to.append(-1)
                length.append(length[last] + 1)
                link.append(0)
                count.append(0)
                while p >= 0:
                    have = word[p]
                    if have == w:
                        q = to[p]
                        break
                    if have < 0:
                        word[p], to[p] = w, new
                    else:
                        edges = more.get(p)
                        if edges is None:
                            more[p] = {w: new}
                        elif w in edges:
                            q = edges[w]
                            break
                        else:
                            edges[w] = new
                    p = link[p]
                if p >= 0:
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = new
            count[last] += times

    def close(self) -> None:
        """Counts go up the suffix links, longest states first."""
        length, link, count = np.array(self.length), np.array(self.link), np.array(self.count)
        order = np.argsort(-length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for level in np.split(order, cuts)[:-1]:
            np.add.at(count, link[level], count[level])
        self.count = np.minimum(count, 2).tolist()

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal spans of words under sequences of ``least`` words that
        occur twice or more."""
        word, to, more, link, length, count, ids = self.word, self.to, self.more, self.link, self.length, self.count, self.ids
        s = have = 0
        out: list[tuple[int, int]] = []
        a = b = 0
        for i, x in enumerate(words, 1):
            w = ids.get(x, -2)
            while True:
                if word[s] == w:
                    t = to[s]
                    break
                edges = more.get(s)
                t = edges.get(w, -1) if edges else -1
                if t >= 0 or not s:
                    break
                s = link[s]
                have = length[s]
            if t >= 0:
                s = t
                have += 1
                while length[link[s]] >= least:  # no longer than asked for
                    s = link[s]
                    have = length[s]
                if have >= least and count[s] > 1:
                    if i - least > b or not b:
                        if b:
                            out.append((a, b))
                        a = i - least
                    b = i
        if b:
            out.append((a, b))
        return out

    def pack(self) -> bytes:
        """The automaton as compressed differences."""
        n = len(self.link)
        edges = self.more.values()
        size = np.array([len(e) for e in edges], np.int32)
        words = np.fromiter((w for e in edges for w in e), np.int32, size.sum())
        to = np.fromiter((q for e in edges for q in e.values()), np.int32, size.sum())
        place = np.arange(n, dtype=np.int32)
        arrays = [np.array(self.word, np.int32), np.array(self.to, np.int32) - place, np.diff(np.array(self.link, np.int32), prepend=np.int32(0)),
                  np.diff(np.array(self.length, np.int32), prepend=np.int32(0)), np.array(list(self.more), np.int32), size, words, to]
        head = np.array([n, len(size), len(words)], np.int64).tobytes()
        data = head + b"".join(x.tobytes() for x in arrays) + bytes(self.count) + b" ".join(self.ids)
        return zstandard.ZstdCompressor(level=PACKED).compress(data)

    @classmethod
    def unpack(cls, data: bytes) -> Automaton:
        data = zstandard.ZstdDecompressor().decompress(data)
        n, k, m = (int(x) for x in np.frombuffer(data, np.int64, 3))
        at = 24

        def ints(size: int) -> np.ndarray:
            nonlocal at
            at += 4 * size
            return np.frombuffer(data, np.int32, size, at - 4 * size)

        out = cls()
        out.word, out.to = ints(n).tolist(), (ints(n) + np.arange(n, dtype=np.int32)).tolist()
        out.link, out.length = np.cumsum(ints(n), dtype=np.int32).tolist(), np.cumsum(ints(n), dtype=np.int32).tolist()
        states, sizes, words, to = ints(k).tolist(), ints(k), ints(m).tolist(), ints(m).tolist()
        ends = np.cumsum(sizes).tolist()
        out.more = {s: dict(zip(words[e - z:e], to[e - z:e])) for s, e, z in zip(states, ends, sizes.tolist())}
        out.count = list(data[at:at + n])
        names = data[at + n:]
        out.ids = {w: i for i, w in enumerate(names.split(b" "))} if names else {}
        return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, key, hash, n, words), shard by shard -> rows of automata and
    of chunks of pieces; a piece that comes again is passed over."""
    def closed(shard, automaton) -> pa.RecordBatch:
        automaton.close()
        return pa.RecordBatch.from_pylist([{"shard": shard, "automaton": automaton.pack()}], SHARD)

    def chunk(shard, rows) -> pa.RecordBatch:
        k, h, w = zip(*rows)
        w = zstandard.ZstdCompressor(level=PACKED).compress("\n".join(w).encode())
        return pa.RecordBatch.from_pylist([{"shard": shard, "keys": k, "hashes": h, "texts": w}], SHARD)

    at, automaton, rows, before = None, None, [], None
    for batch in batches:
        for shard, key, h, n, words in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != at:
                if at is not None:
                    yield chunk(at, rows)
                    yield closed(at, automaton)
                at, automaton, rows, before = shard, Automaton(), [], None
            if (key, h) == before:
                continue
            before = key, h
            if len(rows) == CHUNK:
                yield chunk(at, rows)
                rows = []
            rows.append((key, h, words))
            automaton.add(words.encode().split(b" "), n)
    if at is not None:
        yield chunk(at, rows)
        yield closed(at, automaton)


SHARD = pa.schema([("shard", pa.int64()), ("automaton", pa.binary()), ("keys", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("texts", pa.binary())])


def _stream(length: int):
    """(shard, keys, hashes, texts, automaton) -> each piece's spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                shard, keys, hashes, texts = (batch.column(c)[k].as_py() for c in range(4))
                if shard != at:
                    at, automaton = shard, Automaton.unpack(batch.column(4)[k].as_py())
                cols: list[list] = [[], [], [], []]
                for key, h, words in zip(keys, hashes, zstandard.ZstdDecompressor().decompress(texts).split(b"\n")):
                    for a, b in automaton.spans(words.split(b" "), length):
                        for c, x in zip(cols, (key, h, a, b)):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "hash", "from", "to"])
    return run


# -- the plan -----------------------------------------------------------------

def _merged(spans):
    """Sorted (from, to) structs -> those that don't touch."""
    one = "array<struct<from:bigint,to:bigint>>"
    start = F.struct(F.array().cast(one).alias("done"), F.lit(-1).cast("bigint").alias("f"), F.lit(-1).cast("bigint").alias("t"))

    def out(acc):
        return F.when(acc["t"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["f"].alias("from"), acc["t"].alias("to")))))

    def step(acc, x):
        return (F.when(x["from"] <= acc["t"], F.struct(acc["done"].alias("done"), acc["f"].alias("f"), F.greatest(acc["t"], x["to"]).alias("t")))
                .otherwise(F.struct(out(acc).alias("done"), x["from"].alias("f"), x["to"].alias("t"))))

    return F.aggregate(F.array_sort(spans), start, step, out)


def repeated_spans(texts: DataFrame, length: int = LENGTH, order: int = 0) -> DataFrame:
    """(a, b, n, text), a text known by (a, b) that stands n times, -> (a, b,
    spans) of the texts with repeated windows: the maximal spans of words
    that such windows cover."""
    spark = texts.sparkSession
    every, place = written_at(arrow_map(texts, _find_pieces(length, order), "a long, b long, n long, start long, m long, key long, times long, hash long"), "pieces-at")
    shared = written(every.groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("all")).where(F.col("all") > 1).select("key"), "shared-keys")
    at = written(checked_broadcast_join(every.drop("times"), shared, "key", "left_semi"), "pieces-shared")
    discard(spark, place)
    distinct = at.groupBy("key", "hash").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "start", "m")).alias("of"))
    wanted = written(distinct.groupBy(F.col("of.a").alias("a"), F.col("of.b").alias("b")).agg(
        F.collect_list(F.struct("of.start", "of.m", "key", "hash", "n")).alias("wanted")), "pieces-wanted")
    found = arrow_map(checked_broadcast_join(texts, wanted, ["a", "b"]).select("text", "wanted"), _take_pieces(length),
                      "key long, hash long, n long, words string, size long")
    reference, text_place = written_at(found, "reference")
    by_key = reference.groupBy("key").agg(F.sum("size").alias("size"))
    total, most = by_key.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    hot = None
    if most > KEY_WORDS and order < ORDERS:
        hot = written(by_key.where(F.col("size") > KEY_WORDS).select("key"), "hot-keys")
        cool = checked_broadcast_join(reference, hot, "key", "left_anti")
    else:
        cool = reference
    shards = max(1, -(-total // SHARD_WORDS))
    cool = cool.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "hash", "n", "words").repartition("shard").sortWithinPartitions("shard", "key", "hash")
    built, automata_place = written_at(arrow_map(cool, _build, "shard long, automaton binary, keys array<long>, hashes array<long>, texts binary"), "automata")
    chunks = built.where(F.col("keys").isNotNull()).select("shard", "keys", "hashes", "texts")
    automata = built.where(F.col("automaton").isNotNull()).select("shard", "automaton")
    spans = arrow_map(checked_broadcast_join(chunks, automata, "shard").select("shard", "keys", "hashes", "texts", "automaton"), _stream(length),
                      "key long, hash long, from long, to long")
    if hot is not None:
        again = checked_broadcast_join(reference, hot, "key", "left_semi").dropDuplicates(["key", "hash"])
        again, again_place = written_at(again.select(F.col("key").alias("a"), F.col("hash").alias("b"), "n", F.col("words").alias("text")), "pieces-again")
        again = written(repeated_spans(again, length, order + 1), "spans-again")
        discard(spark, again_place)
        spans = spans.unionByName(again.select(F.col("a").alias("key"), F.col("b").alias("hash"), F.inline("spans")))
    spans = written(spans, "piece-spans")
    discard(spark, text_place)
    discard(spark, automata_place)
    back = checked_broadcast_join(at.select("a", "b", "start", "key", "hash"), spans, ["key", "hash"])
    back = back.select("a", "b", F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to")).alias("span"))
    return back.groupBy("a", "b").agg(_merged(F.collect_set("span")).alias("spans"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                text = spaced(text)
                n = text.count(b" ") + 1 if text else 0
                if spans:
                    starts, ends = bounds(text)
                    edges = [0, *(x for s in spans for x in (s["from"], s["to"])), n]
                    text = b" ".join(text[starts[a]:ends[b - 1]] for a, b in zip(edges[::2], edges[1::2]) if b > a)
                n_words.append(n)
                n_removed.append(sum(s["to"] - s["from"] for s in spans or ()))
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), part.column(2), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (array
    of (from, to) in words, those removed; null where none are) and kept_text
    (the other words, joined by one space).

    Words are runs of characters other than space and 0x09-0x0D, compared as
    they are.  Windows are judged on the input: of equal passages all go, also
    inside one text and in rows that repeat a whole text or a doc_id.  Null
    texts are empty and keep their row; texts under ``length`` words lose
    nothing; null doc_ids stay null.  Texts are read whole.  An empty table
    gives no rows.  Other columns, whatever their names, are not read.
    """
    x = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(column(docs, id_col).cast("bigint").alias("doc_id"), x.alias("text"))
    # rows that agree in both have equal texts (64 bits beside the id) and equal spans
    rows = rows.select(F.coalesce("doc_id", F.lit(-1).cast("bigint")).alias("a"), F.xxhash64("text").alias("b"), "doc_id", "text")
    spans = written(repeated_spans(rows.select("a", "b", F.lit(1).cast("bigint").alias("n"), "text"), length), "text-spans")
    out = checked_broadcast_join(rows, spans, ["a", "b"], "left").select("doc_id", "text", "spans")
    return arrow_map(out, _remove, "doc_id long, n_words long, n_removed long, spans array<struct<from:bigint,to:bigint>>, kept_text string")
