"""Conflict-constrained best-fit packing.

Documents are cut into windows of the capacity; whole windows fill a bin
each, the rests are packed.  Items are dealt to segments by hash (about
SEGMENT items each, at every size of the input: a segment is the unit in
which bins are shared; equal items go there in blocks).  Inside a segment items go from the longest to the
shortest.  Open bins are ordered by what is left in them and carry bitmaps
of their sources and duplicate clusters; the search starts at the tightest
bin that is large enough and goes on to its successors until it meets one
without a conflict, else a new bin opens.  A bin holds one item of a
duplicate cluster at most, and SOURCE_LIMIT of a source.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftkit.functions.index import dense_index
from draftkit.llm.common import arrow_map, column, pieces, written
from draftkit.llm.token_count import text_counter

#: Words of a bin; items of a segment, about; items of a source in a bin.
CAPACITY, SEGMENT, SOURCE_LIMIT = 2048, 2048, 4
#: Equal items that go to a segment together, at most.
COPIES = 64


def best_fit(items: list[tuple[int, object, object]], capacity: int, source_limit: int = SOURCE_LIMIT) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), in the items' order;
    lengths must not exceed the capacity."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    open_bins: list[tuple[int, int]] = []  # (room left, bin), ordered
    sources: list[list[int]] = []  # a bin's bitmaps: sources seen once, twice, ...
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        s = 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (clusters[open_bins[at][1]] & c or sources[open_bins[at][1]][-1] & s):
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * source_limit)
        clusters[b] |= c
        for k, seen in enumerate(sources[b]):
            if not seen & s:
                sources[b][k] = seen | s
                break
        placed.append((b, capacity - room))
        insort(open_bins, (room - length, b))
    return placed


def windows(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            tokenizer_path: str | None = None) -> DataFrame:
    """The items of ``docs``: doc_id, piece, n_tokens (those of the tokenizer
    file, or words between white space without one), source, cluster.  Texts
    that are equal but for the case of A-Z and for white space are a cluster."""
    make = text_counter(docs.sparkSession, tokenizer_path) if tokenizer_path else None

    def run(batches):
        tokens = make() if make else None
        for batch in batches:
            for part in pieces(batch):
                rows = []
                ids, sources = part.column(0).to_pylist(), part.column(2).to_pylist()
                for i, source, text in zip(ids, sources, pc.cast(part.column(1), pa.binary()).to_pylist(), strict=True):
                    words = text.lower().split()
                    n, cluster = tokens(text.decode()) if tokens else len(words), xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
                    for k in range(max(1, -(-n // capacity))):
                        rows.append((i, k, min(capacity, n - k * capacity), source, cluster))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                                                 ["doc_id", "piece", "n_tokens", "source", "cluster"])

    texts = docs.select(column(docs, id_col).cast("bigint").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"),
                        column(docs, source_col).cast("string").alias("source"))
    return arrow_map(texts, run, "doc_id long, piece long, n_tokens long, source string, cluster long")


def pack(items: DataFrame, capacity: int = CAPACITY, segment: int = SEGMENT, source_limit: int = SOURCE_LIMIT) -> DataFrame:
    """``items`` (doc_id, piece, n_tokens <= capacity, source, cluster) with
    bin_id and start (the offset in the bin).  Every item is in one bin;
    items of no tokens are in none (null bin_id and start).

    Null sources are a source of their own, null doc_ids and repeated rows
    are items like any other, and an empty table gives no rows.  Ties go by
    doc_id, piece, source and cluster, so the result depends on the rows
    alone.
    """
    items = written(items.select("doc_id", "piece", "n_tokens", "source", "cluster"), "pack-items")
    rest = items.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    segments = max(1, -(-rest.count() // segment))

    def one(key, table):
        rows = zip(*(table.column(c).to_pylist() for c in [*NAMES, "copies"]), strict=True)
        rows = sorted((r[:-1] for r in rows for _ in range(r[-1])), key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3] or "", r[4]))
        placed = best_fit([(r[2], r[3], r[4]) for r in rows], capacity, source_limit)
        first = (key[0].as_py() + 1) << 32
        cols = [*zip(*rows, strict=True), [first + b for b, _ in placed], [s for _, s in placed]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], _SCHEMA)

    # equal items are counted, and a count goes on as blocks: each of them
    # needs a bin of its own, so many must not meet in one segment
    blocks = rest.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}"))))
    blocks = blocks.select(*NAMES, F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES).alias("copies"),
                           F.pmod(F.xxhash64(*NAMES, "block"), F.lit(segments)).alias("segment"))
    packed = blocks.groupBy("segment").applyInArrow(one, OUT)
    # a window of the full capacity is a bin by itself, numbered by its place
    # in the order of all columns: equal rows may change places, no others
    full = dense_index(items.where(F.col("n_tokens") >= capacity).select(*NAMES), NAMES, "_at")
    full = full.select(*NAMES, (-F.col("_at") - 1).alias("bin_id"), F.lit(0).cast("bigint").alias("start"))
    none = items.where(F.col("n_tokens") <= 0).select(*NAMES, F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("bigint").alias("start"))
    return packed.unionByName(full).unionByName(none)


NAMES = ["doc_id", "piece", "n_tokens", "source", "cluster"]
OUT = "doc_id long, piece long, n_tokens long, source string, cluster long, bin_id long, start long"
_SCHEMA = pa.schema([(p.split()[0], pa.string() if p.endswith("string") else pa.int64()) for p in OUT.split(", ")])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   tokenizer_path: str | None = None) -> DataFrame:
    """The windows of whole documents, packed; lengths are tokens where a
    tokenizer file is given, else words."""
    return pack(windows(docs, capacity, id_col, text_col, source_col, tokenizer_path), capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, n_tokens in them, and fill, the share of the bins'
    room that is used (null without bins)."""
    bins = packed.where(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.sum("n_tokens").alias("n"))
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
                    (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"))
