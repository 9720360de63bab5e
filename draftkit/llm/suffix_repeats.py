"""Repeated passages with a sparse suffix array.

1. Distinct texts (by a 63-bit hash; exact copies share one) become words
   between white space, hashed.  Of every window of MIN_WORDS words the
   position with the smallest hash of GRAM words (the leftmost of equal
   ones) is selected.  Two copies of a passage that long select the same
   positions in it, so only suffixes that start there are kept.
2. Selected suffixes whose GRAM words occur in one text only can't match.
   While the others' hashes are few enough to leave a fixed-size bit table
   nearly empty, it is broadcast; beyond that, positions are joined with the
   hashes.  The second pass over the texts keeps suffixes that pass, with the
   words to their right and, reversed, to their left, as far as a window
   reaches.
3. All kept suffixes are sorted by Spark, by their right side and by their
   left side.  Each is compared with its nearest neighbour of another text
   on both sides; a match extends left and right as far as both agree.
   Four rows of each partition say which row outside of it is the next one
   of another text, and the partition's outer runs are compared with that
   row in a second pass, where they lie.
4. A neighbour with the longest right side may have a short left side while
   another, further off, has enough of both.  Suffixes for which the two
   sorts don't settle that route to an exact comparison of the hashes of
   the few whole windows that could match.
5. Matches of a text merge to maximal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftkit.llm.common import MEMORY, arrow_map, keyed_text, pieces, small_side, written

#: Shortest passage, and words of the hash that selects positions.
MIN_WORDS, GRAM = 51, 6
#: Bits of the table of repeated hashes: 8 MB; hashes that it takes (one bit
#: in sixteen at most is set, so that few others pass).
TABLE_BITS, TABLE_HASHES = 26, 1 << 22
_BLOCK_BITS = 16
#: Words of a text that are handled at once; parts overlap by a window.
CHUNK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)


class Words(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> Words:
    return Words()


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))


def _mix(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words (along the first axis)."""
    out = np.zeros((max(len(words) - n + 1, 0), *words.shape[1:]), np.uint64)
    for i in range(n):
        x = (words[i:i + len(out)] + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def selected(words: np.ndarray, length: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions that some window selects, and their hashes."""
    grams = _mix(words, gram)
    w = length - gram + 1  # grams in a window
    if len(grams) < w:
        return np.zeros(0, np.int64), grams[:0]
    chosen = []
    for a in range(0, len(grams) - w + 1, CHUNK):
        part = grams[a:a + CHUNK + w - 1]
        n = len(part)
        # hash, then position: the smallest is the leftmost of equal hashes
        key = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = (part & ~_POSITION) | np.arange(n, dtype=np.uint64)
        rows = key.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n - w + 1], ahead[w - 1:n])
        chosen.append(np.unique(least & _POSITION).astype(np.int64) + a)
    at = np.unique(np.concatenate(chosen))
    return at, grams[at]


def _text_key(text: bytes) -> int:
    return xxhash.xxh3_128_intdigest(text) % (1 << 63)


def _sides(words: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit words to the right of each position (its own first) and to the
    left (nearest first).  Beyond the text's ends there is 0, which no word
    is."""
    small = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    padded = np.concatenate([np.zeros(length, np.uint32), small, np.zeros(length, np.uint32)])
    right = padded[at[:, None] + np.arange(length, 2 * length)[None, :]]
    left = padded[at[:, None] + np.arange(length - 1, gram - 1, -1)[None, :]]
    return right.astype(">u4"), left.astype(">u4")  # so bytes sort like words


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal beginnings of two rows of words; the end of a
    text ends them."""
    return np.cumprod((a == b) & (a != 0), axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)


def neighbours(first: np.ndarray, second: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by ``first``: equal words on the first and the second
    side with the nearest row of another text before (column 0) and after
    (column 1)."""
    n = len(text)
    new = np.concatenate([[True], text[1:] != text[:-1]])
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [n]])
    one, two = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
    for side, other in ((0, starts[run] - 1), (1, ends[run])):
        for a in range(0, n, 1 << 14):
            mine = np.arange(a, min(a + (1 << 14), n))
            mine = mine[(other[mine] >= 0) & (other[mine] < n)]
            one[mine, side] = _common(first[mine], first[other[mine]])
            two[mine, side] = _common(second[mine], second[other[mine]])
    return one, two


MATCH = "text long, pos long, best long, l0 long, r0 long, l1 long, r1 long, edge int, part int, `left` binary, `right` binary"
_NAMES = ["text", "pos", "best", "l0", "r0", "l1", "r1", "edge", "part", "left", "right"]
#: Kinds of rows: an inner match; a row of the partition's first or last run of
#: one text; the first and last row, and the next ones of another text.
INNER, HEAD, TAIL, FIRST, LAST, AFTER_HEAD, BEFORE_TAIL = range(7)


def _flat(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), ">u4").reshape(len(col), -1)


def _compare(by: str):
    """Compares the sorted rows of a partition with their neighbours; the
    outer runs' rows, and the rows that other partitions must know, come out
    once more with their sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table, part = pa.Table.from_batches(got).combine_chunks(), TaskContext.get().partitionId()
        text, pos = table.column("text").to_numpy(), table.column("pos").to_numpy()
        side = {c: _flat(table.column(c)) for c in ("left", "right")}
        one, two = neighbours(side[by], side["left" if by == "right" else "right"], text)
        left, right = (one, two) if by == "left" else (two, one)

        def rows(at, cols, edge, sides):
            n = len(at)
            last = [table.column(c).take(pa.array(at)) if sides else pa.nulls(n, pa.binary()) for c in ("left", "right")]
            table_ = pa.table([pa.array(text[at]), pa.array(pos[at]), *cols, pa.array(np.full(n, edge, np.int32)), pa.array(np.full(n, part, np.int32)), *last], _NAMES)
            return table_.to_batches(max_chunksize=1 << 14)

        everything = np.arange(len(text))
        yield from rows(everything, [pa.array(x) for x in (one.max(axis=1), left[:, 0], right[:, 0], left[:, 1], right[:, 1])], INNER, False)
        new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        head, tail = everything[:new[1] if len(new) > 1 else None], everything[new[-1]:]
        known = [(FIRST, everything[:1]), (LAST, everything[-1:])]
        if len(new) > 1:
            known += [(AFTER_HEAD, new[1:2]), (BEFORE_TAIL, new[-1:] - 1)]
        for edge, at in [(HEAD, head), (TAIL, tail), *known]:
            yield from rows(at, [pa.array(np.zeros(len(at), np.int64))] * 5, edge, True)
    return run


def outer_neighbours(parts: dict[int, dict[int, tuple]]) -> list[tuple]:
    """(partition, HEAD or TAIL, left, right) of the nearest rows of another
    text outside of each partition; ``parts`` has each one's known rows as
    (text, left, right)."""
    out = []
    for order, edge, mine, near, far in ((sorted(parts), HEAD, FIRST, LAST, BEFORE_TAIL), (sorted(parts, reverse=True), TAIL, LAST, FIRST, AFTER_HEAD)):
        row = other = None  # the nearest row so far, and the nearest one of a text other than its
        for p in order:
            known = parts[p]
            if row:
                at = row if row[0] != known[mine][0] else other
                if at:
                    out.append((p, edge, at[1], at[2]))
            if far in known:
                other = known[far]
            elif row and row[0] != known[near][0]:
                other = row
            row = known[near]
    return out


def _outer(by: str):
    """Outer runs' rows beside the row outside of their partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = _common(_flat(batch.column(3)), _flat(batch.column(5))), _common(_flat(batch.column(4)), _flat(batch.column(6)))
            head, zero = batch.column(2).to_numpy() == HEAD, np.zeros(batch.num_rows, np.int64)
            cols = [left if by == "left" else right, *(np.where(c, x, zero) for c in (head, ~head) for x in (left, right))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols)], _NAMES[:7])
    return run


def _matched(suffixes: DataFrame, by: str) -> DataFrame:
    """Every suffix with its neighbours' matches in the sort by one side."""
    order = [by, "text", "pos"]
    rows = suffixes.select("text", "pos", "left", "right")
    got = written(arrow_map(rows.orderBy(*order), _compare(by), MATCH), f"repeats-by-{by}")
    parts: dict[int, dict[int, tuple]] = {}
    for r in got.where(F.col("edge") >= FIRST).select("part", "edge", "text", "left", "right").collect():  # four rows a partition
        parts.setdefault(r.part, {})[r.edge] = (r.text, bytes(r.left), bytes(r.right))
    near = suffixes.sparkSession.createDataFrame(outer_neighbours(parts), "part int, edge int, near_left binary, near_right binary")
    outer = got.where(F.col("edge").isin(HEAD, TAIL)).join(F.broadcast(near), ["part", "edge"])
    outer = arrow_map(outer.select("text", "pos", "edge", "left", "right", "near_left", "near_right"), _outer(by), MATCH.split(", edge")[0])
    keep = ["text", "pos", F.col("best").alias(f"best_{by}"), F.lit(0).cast("long").alias("best_left" if by == "right" else "best_right"), "l0", "r0", "l1", "r1"]
    return got.where(F.col("edge") == INNER).select(*keep).unionByName(outer.select(*keep))


def _bit_table(hashes: DataFrame) -> bytes:
    """The bit table of the hashes, gathered in blocks of fixed number and
    size."""
    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _BLOCK_BITS, bool)
        for b in batches:
            bits[b.column("at").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["block", "bits"])

    index = F.shiftrightunsigned("gram", 64 - TABLE_BITS)
    blocks = hashes.select(F.shiftright(index, _BLOCK_BITS).alias("block"), index.bitwiseAND((1 << _BLOCK_BITS) - 1).alias("at"))
    out = bytearray(1 << (TABLE_BITS - 3))
    size = 1 << (_BLOCK_BITS - 3)
    for r in blocks.groupBy("block").applyInArrow(fill, "block long, bits binary").collect():
        out[r.block * size:(r.block + 1) * size] = r.bits
    return bytes(out)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` that holds a passage of at least
    ``length`` words which another row holds too: doc_id, n_spans,
    repeated_words, spans (start:end in words, end exclusive, comma-joined,
    maximal and disjoint).

    Words are exact; white space between them does not count.  Texts with an
    exact copy are one span as a whole.  Null texts are empty; texts of fewer
    words have no row; repeated rows are copies of each other; of passages that
    are equally long in several texts each text's own span is told; repeats inside
    one text alone don't count.  An empty table gives no rows.  Texts are
    read whole.
    """
    def keys(batches):
        for batch in batches:
            for part in pieces(batch):
                texts = pc.cast(part.column(1), pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_text_key(t) for t in texts], pa.int64()),
                                                  pa.array([len(t.split()) for t in texts], pa.int64())], ["doc_id", "text_key", "n_words"])

    def grams(batches):
        for batch in batches:
            for part in pieces(batch):
                out_g, out_t = [], []
                for t in pc.cast(part.column(1), pa.binary()).to_pylist():
                    g = np.unique(selected(word_hashes(t), length, gram)[1])
                    out_g.append(g.view(np.int64))
                    out_t.append(np.full(len(g), _text_key(t)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_g)), pa.array(np.concatenate(out_t))], ["gram", "text"])

    def places(batches):
        for batch in batches:
            for part in pieces(batch):
                for i, t in zip(part.column(0).to_pylist(), pc.cast(part.column(1), pa.binary()).to_pylist()):
                    at, g = selected(word_hashes(t), length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array([i] * len(at), pa.int64()), pa.array(at)], ["gram", "doc_id", "pos"])

    def suffixes_with(shared):
        """Suffixes that the bit table passes or, without one, whose places
        are listed beside the text."""
        def suffixes(batches):
            bits = np.frombuffer(shared.value, np.uint8) if shared else None
            for batch in batches:
                for part in pieces(batch, 64):
                    for k, t in enumerate(pc.cast(part.column(1), pa.binary()).to_pylist()):
                        words = word_hashes(t)
                        at, g = selected(words, length, gram)
                        if shared:
                            i = g >> np.uint64(64 - TABLE_BITS)
                            at = at[(bits[i >> np.uint64(3)] >> (np.uint64(7) - (i & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                        else:
                            at = at[np.isin(at, np.asarray(part.column(2)[k].as_py(), np.int64))]
                        for a in range(0, len(at), 1 << 12):
                            right, left = _sides(words, at[a:a + (1 << 12)], length, gram)
                            n = len(right)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _text_key(t))), pa.array(at[a:a + n]),
                                                              pa.array([x.tobytes() for x in left], pa.binary()), pa.array([x.tobytes() for x in right], pa.binary())],
                                                             ["text", "pos", "left", "right"])
        return suffixes

    texts = keyed_text(docs, id_col, text_col)
    rows = written(arrow_map(texts, keys, "doc_id long, text_key long, n_words long"), "repeats-texts").withColumnRenamed("text_key", "text")
    groups = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    copied = written(groups.where("copies > 1"), "repeats-copies")
    # one row of each text goes on: ids that are not the first of any text drop out
    copies = rows.join(small_side(copied), "text")
    spare = copies.where("doc_id <> first").select("doc_id").distinct()
    needed = rows.join(small_side(copied), "text", "left_anti").select("doc_id").unionByName(copies.where("doc_id = first").select("doc_id"))
    spare = small_side(written(spare.join(needed, "doc_id", "left_anti"), "repeats-spare"))
    texts = texts.join(spare, "doc_id", "left_anti")

    shared_grams = (arrow_map(texts, grams, "gram long, text long").groupBy("gram")
                    .agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("gram"))
    shared_grams = written(shared_grams, "repeats-grams")
    if shared_grams.count() <= TABLE_HASHES:
        passing, bits = texts, docs.sparkSession.sparkContext.broadcast(_bit_table(shared_grams))
    else:  # rows that repeat a doc_id have each other's places, which only lets more suffixes pass
        at = arrow_map(texts, places, "gram long, doc_id long, pos long").join(shared_grams, "gram", "left_semi")
        at = written(at.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("places")), "repeats-places")
        passing, bits = texts.join(at, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "places"), None
    suffixes = written(arrow_map(passing, suffixes_with(bits), "text long, pos long, `left` binary, `right` binary"), "repeats-suffixes")

    both = _matched(suffixes, "right").unionByName(_matched(suffixes, "left"))
    pair = lambda k: F.struct(F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    # at most eight matches a suffix: two sorts, two neighbours, two at borders
    found = both.groupBy("text", "pos").agg(F.max("best_left").alias("best_left"), F.max("best_right").alias("best_right"),
                                            F.array_distinct(F.flatten(F.collect_set(F.array(pair(0), pair(1))))).alias("m"))
    found = written(found.where(F.col("best_left") + F.col("best_right") >= length), "repeats-found")
    spans = found.select("text", "pos", F.explode("m").alias("m")).where(F.col("m.l") + F.col("m.r") >= length).select(
        "text", (F.col("pos") - F.col("m.l")).alias("start"), (F.col("pos") + F.col("m.r")).alias("end"))
    open_ = found.where(~F.exists("m", lambda m: (m["l"] == F.col("best_left")) & (m["r"] == F.col("best_right"))))
    spans = spans.unionByName(_whole_windows(suffixes, written(open_.select("text", "pos", "best_left", "best_right"), "repeats-open"), length))

    # overlapping spans of a text merge
    order = Window.partitionBy("text").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (spans.distinct().withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
              .withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .groupBy("text", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    listed = merged.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    one = rows.join(small_side(copied), "text", "left_anti").join(listed, "text").select(
        "doc_id", F.size("s").cast("bigint").alias("n_spans"),
        F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]).alias("repeated_words"),
        F.concat_ws(",", F.transform("s", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))).alias("spans"))
    whole = copies.where(F.col("n_words") >= length).select(
        "doc_id", F.lit(1).cast("bigint").alias("n_spans"), F.col("n_words").alias("repeated_words"), F.concat(F.lit("0:"), F.col("n_words").cast("string")).alias("spans"))
    return one.unionByName(whole)


def _whole_windows(suffixes: DataFrame, undecided: DataFrame, length: int) -> DataFrame:
    """Spans (text, start, end) of windows around undecided suffixes that
    another text holds too."""
    def windows(batches):
        for batch in batches:
            for part in pieces(batch):
                text, pos, lb, rb = (part.column(c).to_numpy() for c in ("text", "pos", "best_left", "best_right"))
                n = part.num_rows
                left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), ">u4").reshape(n, -1) for c in ("left", "right"))
                reach = left.shape[1]
                words = np.concatenate([left[:, ::-1], right], axis=1).astype(np.uint64)
                hashes = _mix(words.T, length).T  # of the window at every start
                start = np.arange(hashes.shape[1]) - reach  # from the suffix on
                row, k = np.nonzero((start >= -lb[:, None]) & (start + length <= rb[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(text[row]), pa.array(pos[row] + start[k]), pa.array(hashes[row, k].view(np.int64))], ["text", "start", "hash"])

    rows = suffixes.join(small_side(undecided), ["text", "pos"]).select("text", "pos", "best_left", "best_right", "left", "right")
    hashed = written(arrow_map(rows, windows, "text long, start long, hash long").distinct(), "repeats-windows")
    shared = hashed.groupBy("hash").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("hash")
    return hashed.join(shared, "hash", "left_semi").select("text", "start", (F.col("start") + length).alias("end"))
