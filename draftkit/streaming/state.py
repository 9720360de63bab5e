"""State of a stream as a bucketed, compacted table.

Rows are kept under ``level=L/from=A/bucket=B``: level 0 is one epoch, and a
folder of level L holds the FAN ** L epochs from A on.  An epoch reads the
buckets that its own keys fall in, from the few folders that make up the
epochs before it, so its work is bounded by what it touches, not by how many
epochs there were.  When FAN folders of a level are full they are written
together as one of the next level, so a row is rewritten once a level.

An epoch that runs again overwrites its own folder and reads the same earlier
ones; folders are only merged by later epochs, and a merge that was cut short
has no ``_SUCCESS`` and is made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Epochs (or folders of a level) that are merged at a time.
FAN = 8


class BucketTable:
    """``combine`` (rows -> rows) may shorten what is merged."""

    def __init__(self, spark: SparkSession, path: str, key_cols: list[str], buckets: int = 64, fan: int = FAN,
                 combine: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.keys, self.buckets, self.fan, self.combine = spark, path.rstrip("/"), list(key_cols), buckets, fan, combine

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys (``buckets`` numbers at most)."""
        return sorted(r.b for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def blocks(self, epoch: int) -> list[tuple[int, int]]:
        """(level, first epoch) of the folders that make up the epochs before
        ``epoch``: the digits of the number in base FAN."""
        out, start, level = [], 0, 0
        while self.fan ** (level + 1) <= epoch:
            level += 1
        for k in range(level, -1, -1):
            while start + self.fan ** k <= epoch:
                out.append((k, start))
                start += self.fan ** k
        return out

    def _folder(self, level: int, start: int) -> str:
        return f"{self.path}/level={level}/from={start}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _done(self, level: int, start: int) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._folder(level, start) + "/_SUCCESS"))

    def _read(self, blocks: list[tuple[int, int]], schema: T.StructType, buckets: list[int] | None) -> DataFrame | None:
        fs, path = self._fs()
        wanted = None if buckets is None else {f"bucket={b}" for b in buckets}
        folders = []
        for block in blocks:
            at = path(self._folder(*block))
            if fs.exists(at):
                folders += [s.getPath().toString() for s in fs.listStatus(at)
                            if s.isDirectory() and (s.getPath().getName() in wanted if wanted is not None else s.getPath().getName().startswith("bucket="))]
        if not folders:
            return None
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders).select(*schema.names)

    def _write(self, rows: DataFrame, level: int, start: int) -> None:
        (rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite")
             .partitionBy("bucket").parquet(self._folder(level, start)))

    def put(self, rows: DataFrame, epoch: int) -> None:
        """What the epoch leaves."""
        self._write(rows, 0, epoch)

    def settle(self, epoch: int, schema: T.StructType) -> None:
        """Merge the folders that the epochs before ``epoch`` have filled;
        called first in every epoch."""
        level = 1
        while epoch and epoch % self.fan ** level == 0:
            start, step = epoch - self.fan ** level, self.fan ** (level - 1)
            parts = [(level - 1, start + k * step) for k in range(self.fan)]
            if not self._done(level, start):
                rows = self._read(parts, schema, None)
                rows = rows if rows is not None else self.spark.createDataFrame([], schema)
                self._write(self.combine(rows) if self.combine else rows, level, start)
            fs, path = self._fs()
            for part in parts:
                fs.delete(path(self._folder(*part)), True)
            level += 1

    def before(self, epoch: int, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of the epochs before ``epoch`` in these buckets (None:
        all); None where there are none."""
        return self._read(self.blocks(epoch), schema, buckets)

    def rows(self, schema: T.StructType) -> DataFrame:
        """The rows of all epochs so far."""
        fs, path = self._fs()
        last = 0
        for level in fs.listStatus(path(self.path)) if fs.exists(path(self.path)) else ():
            name = level.getPath().getName()
            if name.startswith("level="):
                ends = [int(f.getPath().getName()[5:]) + self.fan ** int(name[6:]) for f in fs.listStatus(level.getPath())]
                last = max([last, *ends])
        # the folders before the last epoch are merged as that epoch found them
        found = self._read(sorted({*self.blocks(last - 1), (0, last - 1)}), schema, None) if last else None
        return found if found is not None else self.spark.createDataFrame([], schema)
