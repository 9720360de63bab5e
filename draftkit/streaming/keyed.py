"""Keyed streaming state with ``transformWithState`` processors.

A processor keeps a key's open rows in map state (in the RocksDB state store,
not in a frame) and takes its input chunk by chunk, in whatever order files
bring it.  Event-time timers close what the watermark has passed, so state is
bounded by the watermark's delay; rows later than that are dropped, as in any
stream with a watermark.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR = 3_600_000_000


def use_state_store(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def summary(failed: list[bool]) -> tuple[int, int, int, int]:
    """Rows, failures they begin and end with, and their longest run."""
    n, run, best, head = len(failed), 0, 0, len(failed)
    for k, bad in enumerate(failed):
        if bad:
            run += 1
            best = max(best, run)
        else:
            head, run = min(head, k), 0
    return n, head, run, best


def fold_run(run: int, longest: int, part: tuple[int, int, int, int]) -> tuple[int, int]:
    """The run of failures at the end, and the longest so far, with the next
    rows' summary."""
    n, head, tail, best = part
    return (run + n if head == n else tail), max(longest, run + head, best)


#: Rows of a block of a key's state at most; one with more is split in halves.
BLOCK = 512
_NO_TIME, _LAST_ID, _NO_TIMER = -(2 ** 62), 2 ** 63 - 1, -(2 ** 62)
_DIRECTORY = ("block", "us", "event_id", "failed", "n", "head", "tail", "best")


class RunProcessor(StatefulProcessor):
    """Consecutive failures of a key.  Its open rows lie in blocks, stretches
    of the time order of BLOCK rows at most.  Map state: block -> its rows;
    value state: the run and the longest run of the hours that are closed,
    the next timer, and a directory with every block's number, first row and
    summary.  A micro-batch reads and writes the blocks that its rows fall in
    and the directory, not the rows that came before."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", _longs("block"), T.StructType(
            [T.StructField(c, T.ArrayType(t)) for c, t in (("us", T.LongType()), ("event_id", T.LongType()), ("failed", T.BooleanType()))]))
        self.open = handle.getValueState("open", T.StructType(
            [T.StructField(c, T.LongType()) for c in ("run", "longest", "timer", "blocks")]
            + [T.StructField(c, T.ArrayType(T.LongType())) for c in _DIRECTORY]))

    def _load(self) -> None:
        """``self.at``: (block, first row, summary) in time order."""
        self.run, self.longest, self.timer, self.made, self.at = 0, 0, _NO_TIMER, 0, []
        if self.open.exists():
            self.run, self.longest, self.timer, self.made, *columns = self.open.get()
            self.at = [(x[0], (x[1], x[2], bool(x[3])), tuple(x[4:])) for x in zip(*columns)]

    def _save(self) -> None:
        """With a timer for the end of the first open row's hour."""
        if self.at:
            ends = (self.at[0][1][0] // _HOUR + 1) * (_HOUR // 1000)
            if self.timer == _NO_TIMER or ends < self.timer:
                self.handle.registerTimer(ends)
                self.timer = ends
        rows = [(b, us, i, int(bad), *part) for b, (us, i, bad), part in self.at]
        columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in _DIRECTORY]
        self.open.update((self.run, self.longest, self.timer, self.made, *columns))

    def _rows(self, block: int) -> list[tuple]:
        return list(zip(*self.blocks.getValue((block,))))

    def _write(self, block: int, rows: list[tuple]) -> tuple:
        us, ids, failed = (list(c) for c in zip(*rows))
        self.blocks.updateValue((block,), (us, ids, failed))
        return block, rows[0], summary(failed)

    def _put(self, fresh: list[tuple]) -> None:
        fresh.sort()
        firsts, ends = [first for _, first, _ in self.at], len(fresh)
        # from the last block on: splits change no place that is still to come
        for k in range(max(len(firsts), 1) - 1, -1, -1):
            begin = bisect_left(fresh, firsts[k], 0, ends) if k else 0
            if begin == ends:
                continue
            rows = fresh[begin:ends]
            ends = begin
            numbers = []
            if firsts:
                rows = sorted(self._rows(self.at[k][0]) + rows)
                numbers = [self.at[k][0]]
            size = len(rows) if len(rows) <= BLOCK else BLOCK // 2
            parts = [rows[i:i + size] for i in range(0, len(rows), size)]
            fresh_numbers = range(self.made, self.made + len(parts) - len(numbers))
            self.made = fresh_numbers.stop
            self.at[k:k + 1] = [self._write(n, part) for n, part in zip([*numbers, *fresh_numbers], parts)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for chunk in rows:
            fresh = [r for r in zip(chunk["us"].tolist(), chunk["event_id"].tolist(), chunk["failed"].tolist()) if r[0] != _NO_TIME]
            if fresh:
                self._put(fresh)
        self._save()
        run, longest = self.run, self.longest
        for _, _, part in self.at:
            run, longest = fold_run(run, longest, part)
        yield pd.DataFrame([{"user_id": key[0], "max_fail_run": longest, "current_run": run, "alarm": longest >= self.k}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Hours that ended by the watermark are folded, in order: whole
        blocks from their summaries."""
        self._load()
        by = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000 // _HOUR * _HOUR
        while self.at and self.at[0][1][0] < by:
            block, _, part = self.at.pop(0)
            rest = []
            if not self.at or self.at[0][1][0] >= by:  # the last one may go beyond
                rows = self._rows(block)
                rest = [r for r in rows if r[0] >= by]
                part = summary([bad for us, _, bad in rows if us < by])
            self.run, self.longest = fold_run(self.run, self.longest, part)
            if rest:
                self.at.insert(0, self._write(block, rest))
                break
            self.blocks.removeKey((block,))
        self.timer = _NO_TIMER
        self._save()
        yield from ()

    def close(self) -> None:
        pass


RUN_OUT = "user_id bigint, max_fail_run bigint, current_run bigint, alarm boolean"


def failure_alarm_state(events: DataFrame, k: int, delay: str, key_col: str = "user_id") -> DataFrame:
    """Per key of a micro-batch the longest and the current run of
    failures, over all rows so far that came within ``delay``, in time order
    whatever the order of arrival (update mode: a key's last row counts).
    Rows without a time are in no run; of rows of one instant those without
    an id come last."""
    d = events.select(F.col(key_col).cast("bigint").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"),
                      F.coalesce(F.col("event_id").cast("bigint"), F.lit(_LAST_ID)).alias("event_id"),
                      F.coalesce("failed", F.lit(False)).alias("failed"))
    d = d.withWatermark("ts", delay).withColumn("us", F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)))
    use_state_store(events.sparkSession)
    return d.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=RunProcessor(k), outputStructType=RUN_OUT, outputMode="Update", timeMode="EventTime")


class DeltaProcessor(StatefulProcessor):
    """Changes of a counter series.  Map state: scrape -> value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scrapes = handle.getMapState("scrapes", _longs("scrape"), T.StructType([T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = set()
        for chunk in rows:
            for scrape, value in zip(chunk["scrape"].tolist(), chunk["value"].tolist()):
                self.scrapes.updateValue((scrape,), (value,))
                self.handle.registerTimer(scrape * 1000)
                fresh.add(scrape)
        known = sorted((s[0], v[0]) for s, v in self.scrapes.iterator())
        out, last = [], 0.0
        for place, (scrape, value) in enumerate(known):
            # a scrape that came in between changes its successor's delta, too
            if scrape in fresh or place and known[place - 1][0] in fresh:
                out.append((key[0], scrape, value, value - last))
            last = value
        yield pd.DataFrame(out, columns=["series", "scrape", "value", "delta"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Of the scrapes that the watermark has passed only the last one is
        needed: the next scrape's delta counts from it."""
        done = sorted(s[0] for s in self.scrapes.keys() if s[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs())
        for scrape in done[:-1]:
            self.scrapes.removeKey((scrape,))
        yield from ()

    def close(self) -> None:
        pass


def counter_deltas_state(scrapes: DataFrame, delay: str) -> DataFrame:
    """Per counter series the change since the scrape before (the first
    counts from zero), for scrapes (numbered in seconds after 1970, as a
    watermark never lies before that) in any order within ``delay``.  A scrape that comes between two others gives its successor
    again; the last row of a (series, scrape) counts.  A series whose oldest
    scrapes are closed goes on from the last closed one, which gives no new
    row of its own."""
    d = scrapes.withColumn("_ts", F.timestamp_seconds("scrape")).withWatermark("_ts", delay)
    use_state_store(scrapes.sparkSession)
    return d.groupBy("series").transformWithStateInPandas(
        statefulProcessor=DeltaProcessor(), outputStructType="series string, scrape bigint, value double, delta double", outputMode="Update", timeMode="EventTime")


def last_rows(query_out: DataFrame, key_cols: list[str]) -> DataFrame:
    """Of update-mode rows kept by epoch, each key's last."""
    rest = [c for c in query_out.columns if c not in key_cols and c != "epoch"]
    return (query_out.groupBy(*key_cols).agg(F.max_by(F.struct(*rest), "epoch").alias("_v"))
            .select(*key_cols, *[F.col(f"_v.{c}").alias(c) for c in rest]))
