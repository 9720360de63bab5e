"""Quality classifier on random-indexing word vectors.

1. Every word (between white space) falls to a bucket of its letters and a
   bucket of its shape (runs of capitals, small letters and digits; other
   signs as they are); a word equal to the one before it adds a mark.  Each
   bucket has a fixed sparse index vector of +1 and -1.
2. Random indexing: a bucket's context vector is the sum of the index
   vectors of the words around it, over the whole corpus.  Each partition
   sums its own table of fixed size; tables are added up in a tree of
   grouped sums.
3. A document is the mean of its words' (unit) context vectors, beside the
   mean of their own index vectors.
4. A two-layer network in numpy learns the label from a bounded sample of
   labelled documents (SAMPLE rows, by hash), and a temperature fitted on a
   part of the sample that the network did not learn from calibrates its
   probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftkit.llm.common import MEMORY, arrow_map, column, keyed_text, pieces, small_batches, written

#: Buckets of letters and of shapes, dimensions, entries of an index vector,
#: words to either side that count as context.
LETTERS, SHAPES, DIM, ENTRIES, REACH = 1 << 14, 1 << 10, 32, 2, 2
#: Labelled rows that the network may learn from.
SAMPLE = 20_000
THRESHOLD = 0.3
BUCKETS = LETTERS + SHAPES + 1  # the last one: a word that repeats
SAME = BUCKETS - 1
_BLOCK = 1 << 10
_GATHER = 1 << 14


class _Kinds(dict):
    """Code point -> capital, small letter, digit or the sign itself."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if len(self) > MEMORY:
            self.clear()
        self[point] = k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return k


_KINDS = _Kinds()
_ASCII = bytes(ord(_KINDS[k]) for k in range(128)) + bytes(128)


def _shape(word: str) -> str:
    return _short(word[:64].translate(_KINDS))


def _short(kinds: str) -> str:
    return "".join(k for k, _ in groupby(kinds))[:8]


@lru_cache(maxsize=MEMORY)
def _shape_code(kinds: str | bytes) -> int:
    """The bucket of a word's kinds: many words have the same."""
    shape = _short(kinds if isinstance(kinds, str) else kinds.decode())
    return LETTERS * (zlib.crc32(shape.encode()) % SHAPES)


class Buckets(dict):
    """word -> letters bucket + LETTERS * shape bucket."""

    def __missing__(self, word: str) -> int:
        letters = word.lower()
        if not letters.isalnum():
            letters = "".join(filter(str.isalnum, letters))
        head = word[:64]
        kinds = head.encode().translate(_ASCII) if head.isascii() else head.translate(_KINDS)
        got = zlib.crc32(letters.encode()) % LETTERS + _shape_code(kinds)
        if len(self) > MEMORY:
            self.clear()
        self[word] = got
        return got


@lru_cache(maxsize=1)
def _buckets() -> Buckets:
    return Buckets()


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of every bucket's entries (fixed seed)."""
    rng = np.random.default_rng(20)
    dims = np.stack([rng.permutation(DIM)[:ENTRIES] for _ in range(BUCKETS)])
    return dims, rng.choice([-1.0, 1.0], size=(BUCKETS, ENTRIES))


@lru_cache(maxsize=1)
def own_vectors() -> np.ndarray:
    """The index vectors in full."""
    dims, signs = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    np.put_along_axis(own, dims, signs, axis=1)
    return own


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter buckets and shape buckets of all words of all texts, and the
    number of each word's text."""
    words = [t.split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    code = np.fromiter((c for w in words for c in map(_buckets().__getitem__, w)), np.int64, int(size.sum()))
    return code % LETTERS, LETTERS + code // LETTERS, np.repeat(np.arange(len(texts)), size)


def context_sums(texts: list[str], out: np.ndarray) -> None:
    """Adds the texts' contexts to ``out`` (BUCKETS x DIM, float64 holding
    whole numbers, so sums are exact in any order)."""
    letters, shapes, doc = streams(texts)
    dims, signs = index_vectors()
    own = own_vectors()[LETTERS:LETTERS + SHAPES]
    for step in range(1, REACH + 1):
        i = np.flatnonzero(doc[step:] == doc[:-step])
        for mine, near in ((letters[i], letters[i + step]), (letters[i + step], letters[i])):
            for e in range(ENTRIES):
                out += np.bincount(mine * DIM + dims[near, e], signs[near, e], BUCKETS * DIM).reshape(BUCKETS, DIM)
        # shapes are few: count their pairs, then add vectors
        pairs = np.bincount((shapes[i] - LETTERS) * SHAPES + shapes[i + step] - LETTERS, minlength=SHAPES * SHAPES).reshape(SHAPES, SHAPES)
        out[LETTERS:LETTERS + SHAPES] += pairs @ own + pairs.T @ own


def corpus_contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context table of all of ``docs``: a few MB, whatever the corpus."""
    def local(batches):
        from pyspark import TaskContext

        total = np.zeros((BUCKETS, DIM))
        held: list[str] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size > 1 << 21:
                    context_sums(held, total)
                    held, size = [], 0
        if held:
            context_sums(held, total)
        blocks = range(0, BUCKETS, _BLOCK)
        if total.any():
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int64()), pa.array([*blocks], pa.int64()),
                pa.array([total[b:b + _BLOCK].astype(np.int64).astype(np.int32).tobytes() for b in blocks], pa.binary())], ["part", "block", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                x = unpack(x)
                total = x if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], ["part", "block", "sums"])

    def unpack(x: bytes) -> np.ndarray:
        """Partitions' sums have 32 bits, added ones 64; a block's length
        tells."""
        n = {len(np.empty((min(_BLOCK, BUCKETS - b), DIM), np.int32).tobytes()) for b in (0, BUCKETS // _BLOCK * _BLOCK)}
        return np.frombuffer(x, np.int32 if len(x) in n else np.int64).astype(np.int64)

    texts = docs.select(F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    parts = written(arrow_map(texts, local, "part long, block long, sums binary"), "contexts")
    last = parts.agg(F.max("part")).first()[0]
    table = np.zeros((BUCKETS, DIM))
    if last is None:
        return table
    while True:  # a level adds at most 64 tables in a task
        parts = parts.withColumn("part", F.floor(F.col("part") / 64)).groupBy("part", "block").applyInArrow(add, "part long, block long, sums binary")
        last //= 64
        if last == 0:
            break
    for r in parts.collect():  # one row per block, of fixed size
        table[r.block:r.block + _BLOCK] = unpack(r.sums).reshape(-1, DIM)
    return table


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Every bucket's unit context vector and its own index vector."""
    own = own_vectors()
    mean = contexts.sum(axis=0) / max(np.abs(contexts).sum(), 1)
    centred = contexts - mean * np.abs(contexts).sum(axis=1, keepdims=True)
    unit = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    return np.concatenate([unit, own], axis=1).astype(np.float32)


FEATURES = 4 * DIM + 2 * DIM + 3


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row per text: its letters' and shapes' mean vectors, that of the
    repeat mark, the share of repeats, the spread, and the log length."""
    letters, shapes, doc = streams(texts)
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), FEATURES))
    full = np.flatnonzero(n)
    if len(full):
        end = np.cumsum(n)
        size = n[full][:, None].astype(np.float64)
        sums = np.zeros((len(full), 2 * DIM))
        for k, t in enumerate(full):
            for i in range(end[t] - n[t], end[t], _GATHER):  # a long text in parts
                sums[k] += vectors[letters[i:min(i + _GATHER, end[t])]].sum(axis=0)
        a = sums / size
        # shapes are few: count them, then add vectors
        seen = np.bincount(doc * SHAPES + shapes - LETTERS, minlength=len(texts) * SHAPES).reshape(len(texts), SHAPES)
        b = seen[full].astype(np.float64) @ vectors[LETTERS:LETTERS + SHAPES].astype(np.float64) / size
        same = np.concatenate([[False], (letters[1:] == letters[:-1]) & (doc[1:] == doc[:-1])])
        share = np.bincount(doc[same], minlength=len(texts))[full][:, None] / size
        out[full] = np.concatenate([a, b, share * vectors[SAME].astype(np.float64), share,
                                    np.linalg.norm(a[:, DIM:], axis=1, keepdims=True), np.log1p(size) / 10], axis=1)
    return out


# -- the network -----------------------------------------------------------

class Network:
    """Two layers: tanh, then a sigmoid of the output over a temperature."""

    def __init__(self, hidden: int = 32, seed: int = 4):
        self.hidden, self.seed, self.temperature, self.prior = hidden, seed, 1.0, 0.5
        self.weights: list[np.ndarray] | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, rounds: int = 250, decay: float = 1e-4) -> "Network":
        """``check`` marks the rows for the temperature.  With one class
        only, or no rows, scores are the smoothed share of label 1."""
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        if len(np.unique(y[~check])) < 2:
            return self
        tx, ty = x[~check], y[~check]
        self.mean, self.scale = tx.mean(axis=0), tx.std(axis=0) + 1e-3
        z = (tx - self.mean) / self.scale
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], self.hidden)), np.zeros(self.hidden),
             rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.array(np.log(self.prior / (1 - self.prior)))]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for t in range(1, rounds + 1):
            h = np.tanh(z @ w[0] + w[1])
            e = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - ty) / len(ty)
            back = np.outer(e, w[2]) * (1 - h * h)
            grads = [z.T @ back + decay * w[0], back.sum(axis=0), h.T @ e + decay * w[2], e.sum()]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        if len(np.unique(y[check])) == 2:
            raw, want = self.logits(x[check]), y[check]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, -(2 * want - 1) * raw / k)) for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


# -- the operator ----------------------------------------------------------

def held_out(id_col):
    """Documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        label_id_col: str = "doc_id") -> tuple[np.ndarray, Network]:
    """Word vectors of all of ``docs`` and a network fitted on at most SAMPLE
    labelled rows that are not held out.  Null ids and labels are left out;
    an id with several labels has their rounded mean."""
    vectors = word_vectors(corpus_contexts(docs, text_col))
    known = (labels.select(column(labels, label_id_col).cast("bigint").alias("doc_id"), column(labels, label_col).cast("double").alias("y"))
             .where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("y") >= 0.5).alias("y")))
    known = written(known.orderBy(F.xxhash64("doc_id")).limit(SAMPLE), "quality-labels")

    def features(batches):
        for batch in batches:
            for part in pieces(batch):
                x = pooled(part.column(1).to_pylist(), vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    sample = keyed_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    # repeated doc_ids could outnumber the sample: one row of each
    rows = arrow_map(sample, features, "doc_id long, y boolean, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64).reshape(len(rows), FEATURES)
    check = np.array([zlib.crc32(f"check {r.doc_id}".encode()) % 5 == 0 for r in rows], bool)
    return vectors, Network().fit(x, np.array([float(r.y) for r in rows]), check)


def _scorer(docs: DataFrame, model: tuple[np.ndarray, Network]):
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        vectors, net = shared.value
        out = np.empty(len(texts))
        for a in range(0, len(texts), 256):
            part = [t or "" for t in texts.iloc[a:a + 256].tolist()]
            out[a:a + 256] = net.scores(pooled(part, vectors).astype(np.float32).astype(np.float64))
        return pd.Series(out)

    return F.pandas_udf(score, "double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1: how
    likely label 1 is), predicted (1 from THRESHOLD on).

    A score depends on the text alone; null texts score as empty ones.
    Repeated rows give repeated rows; an empty table gives none; without
    labels of both kinds every score is the smoothed share of label 1.
    """
    score = _scorer(docs, fit(docs, labels, id_col, text_col, label_col))
    out = keyed_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier
    predicts as label 1.  The text alone decides: null texts are judged as
    empty ones, rows of one text stay or go together, and scores of exactly
    THRESHOLD stay.  An empty table gives no rows."""
    score = _scorer(docs, fit(docs, labels, id_col, text_col, label_col))
    return docs.where(score(column(docs, text_col).cast("string")) >= THRESHOLD)
