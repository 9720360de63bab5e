"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftkit.session import materialize, scratch_path, small_batches

#: Rows of fixed small width that a broadcast may hold (16 bytes each: 16 MB).
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names differ in case only
    count as equal)."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def column(df: DataFrame, name: str) -> "F.Column":
    """``df``'s column of exactly this name, also when other columns have
    dots in their names."""
    return df[f"`{name}`"]


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; null text is
    the empty text.  All other columns (whatever their names) are pruned."""
    return docs.select(column(docs, id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))


#: Entries of a worker's memory of words.
MEMORY = 100_000


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that only a few texts at a time are Python
    objects."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written, of fixed narrow width) marked for broadcast
    if its counted rows stay under ``limit``; else as it is, for a shuffled
    join.  The rows that come out are the same."""
    return F.broadcast(df) if df.count() <= limit else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return materialize(df, name)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's path, for ``discard``."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table once all that was made from it is written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
