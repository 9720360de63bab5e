"""Exact dedup with counting quotient filters.

1. Every text is lower-cased (A-Z only) and hashed to a 64-bit fingerprint.
2. Each partition builds counting quotient filters: the fingerprints'
   leading bits choose a block; inside a block the next bits are the
   quotient and the rest is the remainder.  A filter keeps which quotients
   occur (a bit each), where each quotient's run of sorted remainders ends
   (a bit per slot), the remainders, and their counts.
3. The filters of a block merge losslessly: runs are sorted, so merging is
   merging of sorted remainders with counts added.  A hot fingerprint is one
   slot with a count in every filter.
4. Fingerprints with a count above one route to byte verification: only
   rows with such a fingerprint are compared by their whole normalised
   text.  All other rows are known to be unique, as equal texts have equal
   fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit.llm.common import arrow_map, column, fresh, keyed_text, pieces, small_side, written

#: Mean number of fingerprints of the corpus in a block.
BLOCK_ITEMS = 1 << 15
#: A partition flushes its filters after so many rows.
FLUSH_ROWS = 1 << 20


# -- the filter ------------------------------------------------------------

def encode_filter(low: np.ndarray, counts: np.ndarray, block_bits: int) -> bytes:
    """Counting quotient filter of the sorted distinct ``low`` (a
    fingerprint's bits below the block's, as uint64)."""
    n = len(low)
    width = 64 - block_bits
    q = min(max(int(n).bit_length(), 3), width - 1)
    quotient = (low >> np.uint64(width - q)).astype(np.int64)
    remainder = low & np.uint64((1 << (width - q)) - 1)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient] = 1
    run_end = np.empty(n, np.uint8)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    run_end[-1:] = 1
    many = np.flatnonzero(counts > 1)
    head = np.array([q, n, len(many)], np.int64)
    return b"".join([head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(),
                     remainder.tobytes(), many.astype(np.int64).tobytes(), counts[many].astype(np.int64).tobytes()])


def decode_filter(data: bytes, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints' low bits and their counts."""
    q, n, k = (int(x) for x in np.frombuffer(data, np.int64, 3))
    at = 24
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, (1 << q) // 8, at))
    at += (1 << q) // 8
    run_end = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at))[:n]
    at += (n + 7) // 8
    remainder = np.frombuffer(data, np.uint64, n, at)
    at += 8 * n
    many = np.frombuffer(data, np.int64, k, at)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, np.int64, k, at + 8 * k)
    run = np.cumsum(run_end) - run_end  # number of the run that a slot is in
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    return (quotient << np.uint64(64 - block_bits - q)) | remainder, counts


def merge_sorted(low: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of distinct remainders with added counts."""
    a, c = np.concatenate(low), np.concatenate(counts)
    order = np.argsort(a, kind="stable")  # merges runs that are sorted already
    a, c = a[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[first], (np.add.reduceat(c, first) if len(a) else c)


def _block_bits(rows: int) -> int:
    return max(1, (max(rows, 1) // BLOCK_ITEMS).bit_length())


def merged_filter(prints: DataFrame, block_bits: int, fp_col: str = "fp") -> DataFrame:
    """The corpus's filter: (block, n, filter), one row per block that has
    fingerprints.  ``prints`` holds a bigint fingerprint per row."""
    bits = np.uint64(64 - block_bits)
    mask = np.uint64((1 << (64 - block_bits)) - 1)

    def build(batches):
        held: list[np.ndarray] = []

        def flush():
            fp, c = np.unique(np.concatenate(held), return_counts=True)
            block = (fp >> bits).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(fp)]])
            rows = [(int(block[a]), encode_filter(fp[a:b] & mask, c[a:b], block_bits))
                    for a, b in zip(cut[:-1], cut[1:], strict=True)]
            held.clear()
            for i in range(0, len(rows), 4096):
                part = rows[i:i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()),
                                                  pa.array([r[1] for r in part], pa.binary())], ["block", "filter"])

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += batch.num_rows
            if n >= FLUSH_ROWS:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def merge(key, table):
        got = [decode_filter(x.as_py(), block_bits) for x in table.column("filter")]
        low, c = merge_sorted([g[0] for g in got], [g[1] for g in got])
        return pa.table({"block": [key[0].as_py()], "n": pa.array([len(low)], pa.int64()),
                         "filter": pa.array([encode_filter(low, c, block_bits)], pa.binary())})

    local = arrow_map(prints.select(column(prints, fp_col).alias("fp")), build, "block long, filter binary")
    return local.groupBy("block").applyInArrow(merge, "block long, n long, filter binary")


def repeated_prints(merged: DataFrame, block_bits: int) -> DataFrame:
    """Fingerprints with a count above one: (fp, copies)."""
    def decode(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, c = decode_filter(data, block_bits)
                fp = (low | (np.uint64(block) << np.uint64(64 - block_bits)))[c > 1]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(c[c > 1])], ["fp", "copies"])

    return arrow_map(merged.select("block", "filter"), decode, "fp long, copies long")


# -- the operator ----------------------------------------------------------

def _prints(batches):
    """(doc_id, text) -> (doc_id, fp, text_sha256)."""
    for batch in batches:
        for part in pieces(batch):
            texts = pc.cast(pc.ascii_lower(part.column(1)), pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "fp", "text_sha256"])


def _lowered(n_cols: int, fp_name: str, norm_name: str):
    """Appends the fingerprint and the normalised text; the text is the
    first column."""
    def run(batches):
        for batch in batches:
            text = pc.fill_null(pc.ascii_lower(batch.column(0)), "")
            fp = np.fromiter((xxhash.xxh64_intdigest(x.as_buffer()) for x in pc.cast(text, pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64)), text],
                                             [*batch.schema.names[:n_cols], fp_name, norm_name])
    return run


def _with_print(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    fp, norm = fresh(docs, "_fp"), fresh(docs, "_norm")
    cols = [text_col, *(c for c in docs.columns if c != text_col)]
    df = docs.select(*(column(docs, c) for c in cols))
    schema = T.StructType([*df.schema.fields, T.StructField(fp, T.LongType()), T.StructField(norm, T.StringType())])
    return arrow_map(df, _lowered(len(cols), fp, norm), schema), fp, norm


def _repeated(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The narrow table of all rows, and the repeated fingerprints; both
    written."""
    narrow = written(arrow_map(keyed_text(docs, id_col, text_col), _prints,
                               "doc_id long, fp long, text_sha256 string"), "exact-prints")
    bits = _block_bits(narrow.count())
    repeated = written(repeated_prints(merged_filter(narrow, bits), bits).select("fp"), "exact-repeated")
    return narrow, repeated


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256.

    Null text counts as empty.  Of equal texts the row with the largest
    doc_id stays; a null doc_id is smaller than any other.  Rows that repeat
    both the doc_id and the text are copies like any other: each counts in
    group_size, and exactly one of them is kept.  An empty table gives no
    rows.  Other columns, whatever their names, are not read.
    """
    narrow, repeated = _repeated(docs, id_col, text_col)
    few = small_side(repeated)
    alone = narrow.join(few, "fp", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    # byte verification: rows whose fingerprint repeats, by their whole text
    whole, fp, norm = _with_print(keyed_text(docs, id_col, text_col).select("text", "doc_id"), "text")
    suspects = written(whole.select("doc_id", F.col(fp).alias("fp"), F.col(norm).alias("norm"))
                       .join(few, "fp", "left_semi"), "exact-suspects")
    # equal texts meet by a map-side combined aggregate, so a hot group is a
    # row per task; the join back is split by AQE where a text is hot
    classes = suspects.groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = suspects.join(classes, ["fp", "norm"]).select(
        "doc_id", "keep_id", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")))
                              .orderBy("keep_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    keepers = found.where(stays).withColumn("n", nth).select(
        "doc_id", "keep_id", "group_size", (F.col("n") == 1).alias("kept"), "text_sha256")
    rest = found.where(~stays).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256")
    return alone.unionByName(keepers).unionByName(rest)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each
    group of equal texts, that with the largest doc_id (of rows that repeat
    the doc_id as well, one)."""
    _, repeated = _repeated(docs, id_col, text_col)
    few = small_side(repeated)
    whole, fp, norm = _with_print(docs, text_col)
    cols = [f"`{c}`" for c in docs.columns]
    alone = whole.join(few.withColumnRenamed("fp", fp), fp, "left_anti").select(*cols)
    suspects = whole.join(few.withColumnRenamed("fp", fp), fp, "left_semi")
    row, order = F.struct(*cols), F.coalesce(F.col(f"`{id_col}`").cast("decimal(20,0)"), F.lit("-99999999999999999999").cast("decimal(20,0)"))
    best = suspects.groupBy(fp, norm).agg(F.max_by(row, order).alias(fresh(docs, "_row")))
    one = fresh(docs, "_row")
    return alone.unionByName(best.select(*(F.col(f"`{one}`.`{c}`").alias(c) for c in docs.columns)))
