"""Product codes of vectors, assigned with a lexicographic trie.

1. Components become integers, vectors are cut into equal consecutive parts.
2. The distinct parts of every part position are counted (with map-side
   combine) and written once, range partitioned and sorted by position and
   components: a sorted run of parts is a trie, level = component.
3. A round walks each run depth first.  A node keeps the squared distances
   that its prefix has run up to every codebook entry, so parts with a common
   prefix pay for it once; a leaf takes the nearest entry and adds its
   components, times its count, to that entry's sums.
4. Tasks give one row of sums per entry and component; Spark adds them, and
   the few hundred totals become the next codebook on the driver.
5. At the end each batch of vectors is walked the same way, so codes and
   errors need no shuffle of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit.functions.joins import BROADCAST_MAX_BYTES, measured_bytes
from draftkit.llm.common import arrow_map, column, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer component: squared distances of 64 of them fit a long.
LARGEST = 1 << 27


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` (entries x components) of every row, and
    its squared distance; ties go to the lower entry.  ``rows`` with equal
    prefixes side by side share the work on them."""
    n, width = rows.shape
    code, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not width:
        return code, dist
    stack = [(0, n, 0, np.zeros(len(book), np.int64))] if n else []
    while stack:
        a, b, k, run_up = stack.pop()
        values = rows[a:b, k]
        start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        size = np.diff(np.append(start, b - a))
        reach = run_up + (values[start][:, None] - book[:, k]) ** 2  # a vector per child
        leaf = size == 1 if k + 1 < width else np.ones(len(size), bool)
        at = a + start[leaf]
        total = reach[leaf]
        for j in range(k + 1, width):  # the tails of children with one part
            total += (rows[at, j][:, None] - book[:, j]) ** 2
        best = total.argmin(1)
        where = np.repeat(at, size[leaf]) + np.arange(size[leaf].sum()) - np.repeat(np.cumsum(size[leaf]) - size[leaf], size[leaf])
        code[where] = np.repeat(best, size[leaf])
        dist[where] = np.repeat(total[np.arange(len(best)), best], size[leaf])
        for c in np.flatnonzero(~leaf)[::-1]:
            stack.append((a + start[c], a + start[c] + size[c], k + 1, reach[c]))
    return code, dist


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(col.flatten(), np.int64)
    if len(flat) != len(col) * width:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(col), width)


def _round(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the counted distinct parts."""
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((positions, entries, width), np.int64), np.zeros((positions, entries), np.int64)
        for batch in batches:
            pos, weight = (np.asarray(batch.column(k), np.int64) for k in (0, 2))
            rows = _matrix(batch.column(1), width)
            for p in np.unique(pos):
                at = np.flatnonzero(pos == p)
                code, _ = nearest(rows[at], books[p])
                np.add.at(sums[p], code, rows[at] * weight[at][:, None])
                np.add.at(counts[p], code, weight[at])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width)), pa.array(np.repeat(e, width)), pa.array(np.tile(np.arange(width), len(p))),
             pa.array(np.repeat(counts[p, e], width)), pa.array(sums[p, e].ravel())], ["p", "e", "j", "n", "s"])

    totals = arrow_map(parts, run, "p long, e long, j long, n long, s long").groupBy("p", "e", "j").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = books.copy()
    for r in totals.collect():  # positions x entries x components at most
        out[r.p, r.e, r.j] = int(r.s) // int(r.n)
    return out


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components, decimal, by part, entry, place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): codes has one row per kept vector: vec_id, label,
    code (array of entry numbers, one for each part), error (squared
    distances summed over parts); codebooks is parts x entries x components.

    Rows whose vector is null, empty or holds null or non-finite components
    are dropped; no kept rows give no codes and empty codebooks.  The first
    codebook is cut from the ``entries`` smallest ids (fewer rows: fewer
    entries; rows that repeat an id go by their vector; null ids come last).
    Repeated rows each count and each come out.  Equal distances go to the
    lower entry.  Vectors must have one length, a multiple of ``parts``, and
    components of at most 32768 in size (else the job fails by name: longs
    would overflow).  Other columns, whatever their names, are not read.
    """
    x = column(vectors, vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint"))
    kept = vectors.where(x.isNotNull() & (F.size(x) > 0) & fine).select(
        column(vectors, id_col).alias("vec_id"), column(vectors, label_col).alias("label"),
        F.when(F.exists(whole, lambda v: F.abs(v) > LARGEST), F.raise_error(F.lit("a vector's component is over 32768")).cast("array<bigint>"))
        .otherwise(whole).cast("array<int>").alias("v"))
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width, rest = divmod(len(first[0]), parts) if first else (0, 0)
    if rest or len({len(v) for v in first}) > 1:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width))
    if first:
        counted = kept.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n"))
        table = written(counted.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "vector-parts")
        for _ in range(rounds):
            books = _round(table, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(2), parts * width)
            codes, error = np.zeros((len(rows), parts), np.int32), np.zeros(len(rows), np.int64)
            for p in range(parts):
                part = rows[:, p * width:(p + 1) * width]
                order = np.lexsort(part.T[::-1])
                code, dist = nearest(part[order], books[p])
                codes[order, p] = code
                error[order] += dist
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), parts).cast(pa.list_(pa.int32())), pa.array(error)],
                ["vec_id", "label", "code", "error"])

    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return arrow_map(kept, run, schema), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` (written once here) with label_error: the errors summed over
    rows of the same label, null labels together.  The sums are broadcast
    where they measure few bytes, else joined by label."""
    codes = written(codes, "vector-codes")
    total = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    side = F.broadcast(total) if measured_bytes(total) <= BROADCAST_MAX_BYTES else total
    return codes.join(side, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
