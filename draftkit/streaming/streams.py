"""Structured Streaming versions of the incremental operators.

Each function takes a streaming DataFrame and returns a started query (or a
streaming DataFrame) built from the same batch operators.  Sinks are file
folders given by the caller (the registered queries use folders under the
shared checkpoint folder).

Ordering and replay: files may arrive in any order and an epoch may run
again.  The table forms (``foreachBatch``) write each micro-batch to its own
``epoch=N`` folder, which a replay overwrites, read only earlier epochs, and
combine epochs in a way that does not depend on their order: sums of counts,
keys not seen before, whole conversations rebuilt, summaries of hours folded
in time order.  What an epoch must know of earlier ones is in a bucketed table
(``streaming/state.py``) of which it reads the buckets of its own keys.  The
forms with a watermark or keyed Python state are for streams that
are in time order up to the watermark.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from draftkit.session import scratch_path
from draftkit.streaming.state import BucketTable


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, name)


def run_available(query) -> None:
    """Drive a query started with ``availableNow`` to completion."""
    query.awaitTermination()


# ------------------------------------------------------------------ X1
def prompt_intake(stream: DataFrame, lang: str | None, out: str, ckpt: str,
                  key_col: str = "doc_id", text_col: str = "text"):
    """Filter by language, drop empty prompts, key as string; appended
    to a parquet folder."""
    d = stream.filter(F.coalesce(F.length(F.trim(F.col(text_col))), F.lit(0)) > 0)
    if lang is not None:
        d = d.filter(F.col("lang") == lang)
    d = d.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("prompt"))
    return (d.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())


def response_sink(responses: DataFrame, out: str, ckpt: str):
    """S6 (stream): append finished response rows as JSON lines; the
    checkpoint makes a restarted query continue without duplicates."""
    return (responses.writeStream.format("json").option("path", out).option("checkpointLocation", ckpt)
                     .outputMode("append").trigger(availableNow=True).start())


# ------------------------------------------------------------------ epochs
def epoch_sink(path: str, make, history: bool = True):
    """A ``foreachBatch`` function that writes ``make(batch, earlier)`` to
    ``path/epoch=N``; ``earlier`` holds what the epochs before wrote (``None``
    at first, and always where ``history`` is off: listing and reading all
    epochs costs more with each).  A replayed epoch rewrites its folder."""
    from draftkit.sources.readers import path_exists

    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        earlier = None
        if history and epoch_id > 0 and path_exists(spark, path):
            earlier = spark.read.option("mergeSchema", "true").parquet(path).filter(F.col("epoch") < epoch_id)
        make(batch, earlier).write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return sink


def run_epochs(stream: DataFrame, sink, ckpt: str):
    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
                  .trigger(availableNow=True).start())


# ------------------------------------------------------------------ X2
def dedup_by_key(stream: DataFrame, key_cols: list[str], ts_col: str, delay: str) -> DataFrame:
    """X2 for a stream in time order: replays and duplicates removed per key
    while the watermark keeps their state
    (``dropDuplicatesWithinWatermark``); rows later than it are dropped."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(key_cols)


def dedup_table(stream: DataFrame, key_cols: list[str], out: str, ckpt: str, state: str | None = None, buckets: int = 64):
    """X2 in any order: a batch's rows whose keys no earlier epoch has are
    written to ``out``; the keys are kept in a bucketed table (``state``, by
    default beside ``out``), and an epoch looks for its keys in their buckets
    only."""
    state = state or out.rstrip("/") + "-keys"

    def sink(batch: DataFrame, epoch_id: int) -> None:
        keys = BucketTable(batch.sparkSession, state, key_cols, buckets)
        schema = batch.select(*key_cols).schema
        keys.settle(epoch_id, schema)
        new = batch.dropDuplicates(key_cols)
        seen = keys.before(epoch_id, schema, keys.touched(batch)) if epoch_id else None
        if seen is not None:
            new = _unseen(new, seen, key_cols)
        folder = f"{out}/epoch={epoch_id}"
        new.write.mode("overwrite").parquet(folder)
        keys.put(batch.sparkSession.read.schema(batch.schema).parquet(folder).select(*key_cols), epoch_id)
    return run_epochs(stream, sink, ckpt)


def _unseen(rows: DataFrame, seen: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows whose keys are not in ``seen``; null keys are equal."""
    named = seen.select(*[F.col(c).alias(f"_seen_{k}") for k, c in enumerate(key_cols)])
    same = [F.col(c).eqNullSafe(F.col(f"_seen_{k}")) for k, c in enumerate(key_cols)]
    return rows.join(named, reduce(lambda a, b: a & b, same), "left_anti")


# ------------------------------------------------------------------ X3
def running_token_frequency(tokens: DataFrame, out: str, ckpt: str, token_col: str = "token"):
    """Every micro-batch's token counts (``latest_counts`` adds them up:
    counts of disjoint batches are additive, so there is no state to keep)."""
    def make(batch, earlier):
        return batch.groupBy(token_col).agg(F.count(F.lit(1)).alias("freq"))
    return run_epochs(tokens, epoch_sink(out, make, history=False), ckpt)


def latest_counts(spark: SparkSession, path: str, key_cols: list[str], value_cols: list[str] = ("freq",)) -> DataFrame:
    """Current values per key of additive epochs."""
    return spark.read.parquet(path).groupBy(*key_cols).agg(*[F.sum(c).alias(c) for c in value_cols])


# ------------------------------------------------------------------ X4
def _tallies(events: DataFrame, ts_col: str, window: str, error_col: str) -> DataFrame:
    return (events.groupBy(F.window(ts_col, window).alias("w"))
                  .agg(F.count_if(~F.col(error_col)).alias("n_ok"), F.count_if(F.col(error_col)).alias("n_error"))
                  .select(F.col("w.start").alias("window_start"), "n_ok", "n_error"))


def windowed_tallies(events: DataFrame, window: str, delay: str, ts_col: str = "ts",
                     error_col: str = "failed") -> DataFrame:
    """X4 for a stream in time order: ok/error tallies per event-time window;
    rows later than the watermark are dropped.  ``timestamp_ntz`` is cast to
    ``timestamp`` because watermarks need the latter."""
    d = events.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", delay)
    return _tallies(d, "_ts", window, error_col)


def tally_table(events: DataFrame, window: str, out: str, ckpt: str, ts_col: str = "ts", error_col: str = "failed"):
    """X4 in any order: each epoch's tallies per window are additive
    (``latest_counts``); no row is too late."""
    def make(batch, earlier):
        return _tallies(batch.withColumn("_ts", F.col(ts_col).cast("timestamp")), "_ts", window, error_col)
    return run_epochs(events, epoch_sink(out, make, history=False), ckpt)


# ------------------------------------------------------------------ X5
ALARM_OUT = "user_id long, max_fail_run long, current_run long, alarm boolean"
ALARM_STATE = "run long, max_run long"


def _alarm_fn(k: int):
    def fn(key, pdfs, state):
        run, max_run = (state.get if state.exists else (0, 0))
        # a key's rows may span several Arrow chunks: order them across the
        # whole micro-batch (memory bounded by the trigger's batch size)
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"])
        for failed in batch["failed"].to_numpy():
            run = run + 1 if failed else 0
            max_run = max(max_run, run)
        state.update((int(run), int(max_run)))
        yield pd.DataFrame([{"user_id": int(key[0]), "max_fail_run": int(max_run), "current_run": int(run),
                             "alarm": bool(max_run >= k)}])
    return fn


def failure_alarm(events: DataFrame, k: int, key_col: str = "user_id") -> DataFrame:
    """Consecutive-failure alarm per key with keyed state (run length,
    longest run); rows of a micro-batch are ordered by time in the handler."""
    d = events.select(F.col(key_col).alias("user_id"), "ts", "event_id", "failed")
    return d.groupBy("user_id").applyInPandasWithState(
        _alarm_fn(k), ALARM_OUT, ALARM_STATE, "update", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ X6
DELTA_OUT = "series string, scrape long, value double, delta double"
DELTA_STATE = "last double"


def _delta_fn(key, pdfs, state):
    last = state.get[0] if state.exists else None
    rows = []
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values("scrape")
    for scrape, value in batch[["scrape", "value"]].itertuples(index=False):
        rows.append({"series": key[0], "scrape": int(scrape), "value": float(value),
                     "delta": float(value - last) if last is not None else float(value)})
        last = value
    if last is not None:
        state.update((float(last),))
    yield pd.DataFrame(rows, columns=["series", "scrape", "value", "delta"])


def counter_deltas(scrapes: DataFrame) -> DataFrame:
    """Per counter series the change since the previous scrape (the
    first scrape counts from zero); the last value is keyed state."""
    return scrapes.groupBy("series").applyInPandasWithState(
        _delta_fn, DELTA_OUT, DELTA_STATE, "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ X7
def incremental_build(turn_rows: DataFrame, build, store: str, out: str, ckpt: str, key_col: str = "conv_id", buckets: int = 64):
    """Apply a batch plan (``build: DataFrame -> DataFrame``, e.g. the
    prepare plan, one or more rows per conversation) to the conversations
    that a micro-batch touches.  Turn rows are kept in ``store``, a bucketed
    table; a conversation that goes on in a later file is built again from
    all its turns, for which only the buckets of the touched conversations
    are read, and ``latest_build`` takes each conversation's last build."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        turns = BucketTable(batch.sparkSession, store, [key_col], buckets)
        turns.settle(epoch_id, batch.schema)
        earlier = turns.before(epoch_id, batch.schema, turns.touched(batch)) if epoch_id else None
        rows = batch
        if earlier is not None:
            mine = batch.select(F.col(key_col).alias("_mine")).distinct()
            rows = batch.unionByName(earlier.join(mine, F.col(key_col).eqNullSafe(F.col("_mine")), "left_semi"))
        build(rows).write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
        turns.put(batch, epoch_id)
    return run_epochs(turn_rows, sink, ckpt)


def latest_build(spark: SparkSession, out: str, key_col: str = "conv_id") -> DataFrame:
    rows = spark.read.parquet(out)
    last = rows.groupBy(F.col(key_col).alias("_k")).agg(F.max("epoch").alias("_e"))
    return rows.join(last, F.col(key_col).eqNullSafe(F.col("_k")) & (F.col("epoch") == F.col("_e"))).drop("_k", "_e", "epoch")


# ------------------------------------------------------------------ X5 (tables)
def _order_value(kind: T.DataType, c: Column) -> Column:
    """Hours of an instant, else the value in steps of 4096."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(3_600_000_000)).cast("bigint")
    return F.floor(c / F.lit(4096)).cast("bigint")


def run_summaries(rows: DataFrame, key_cols: list[str], hour_col: str, order_cols: list[str], failed_col: str = "failed") -> DataFrame:
    """What a key's rows of an hour mean for runs of failures, as a summary
    that adds up in time order: ``n`` rows, ``head`` failures before the first
    success (all, if there is none), ``tail`` failures after the last one,
    ``longest`` run."""
    by = [*key_cols, hour_col]
    sofar = Window.partitionBy(*by).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = rows.withColumn("_isl", F.sum(F.when(F.col(failed_col), 0).otherwise(1)).over(sofar))
    runs = d.groupBy(*by, "_isl").agg(F.count(F.lit(1)).alias("_n"), F.count_if(failed_col).alias("_len"))
    return runs.groupBy(*by).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_isl") == 0, F.col("_len"))), F.lit(0)).alias("head"),
                                 F.max_by("_len", "_isl").alias("tail"), F.max("_len").alias("longest"))


def fold_summaries(summaries: DataFrame, key_cols: list[str], hour_col: str) -> DataFrame:
    """Summaries of a key, one an hour, added up in time order: ``max_run``
    and ``current_run``."""
    parts = F.array_sort(F.collect_list(F.struct(hour_col, "n", "head", "tail", "longest")))
    zero = F.lit(0).cast("bigint")

    def add(acc, s):
        run = F.when(s["head"] == s["n"], acc["run"] + s["n"]).otherwise(s["tail"])
        return F.struct(run.alias("run"), F.greatest(acc["longest"], acc["run"] + s["head"], s["longest"]).alias("longest"))

    got = F.aggregate("_s", F.struct(zero.alias("run"), zero.alias("longest")), add)
    return (summaries.groupBy(*key_cols).agg(parts.alias("_s")).withColumn("_g", got)
            .select(*key_cols, F.col("_g.longest").alias("max_run"), F.col("_g.run").alias("current_run")))


_SUMMARY = "_hour bigint, n bigint, head bigint, tail bigint, longest bigint, _epoch bigint"


def _latest(key_cols: list[str]):
    """Of an hour's summaries the last epoch's, which knows all its rows."""
    def combine(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key_cols, "_hour")]
        return (rows.groupBy(*key_cols, "_hour").agg(F.max_by(F.struct(*rest), "_epoch").alias("_v"))
                .select(*[F.col(c) if c in (*key_cols, "_hour") else F.col(f"_v.{c}").alias(c) for c in rows.columns]))
    return combine


def _summary_table(spark: SparkSession, state_path: str, key_cols: list[str]) -> BucketTable:
    return BucketTable(spark, state_path.rstrip("/") + "/summaries", [*key_cols], combine=_latest(list(key_cols)))


def failure_alarm_tables(events: DataFrame, state_path: str, ckpt: str, key_cols: list[str] = ("user_id",),
                         order_cols: list[str] = ("ts", "event_id"), failed_col: str = "failed", buckets: int = 64):
    """X5 in any order, without per-key Python.  The narrow rows (key, order,
    failed) are kept in a table bucketed by key and hour; an epoch reads the
    buckets of the (key, hour) pairs it touches, and leaves those hours'
    summaries.  ``alarm_table`` reads summaries only."""
    keys = list(key_cols)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        narrow = batch.select(*keys, *order_cols, F.coalesce(F.col(failed_col), F.lit(False)).alias(failed_col))
        narrow = narrow.withColumn("_hour", _order_value(batch.schema[order_cols[0]].dataType, F.col(order_cols[0])))
        store = BucketTable(spark, state_path.rstrip("/") + "/rows", [*keys, "_hour"], buckets)
        found = _summary_table(spark, state_path, keys)
        store.settle(epoch_id, narrow.schema)
        earlier = store.before(epoch_id, narrow.schema, store.touched(narrow)) if epoch_id else None
        rows = narrow
        if earlier is not None:
            mine = narrow.select(*[F.col(c).alias(f"_m{k}") for k, c in enumerate([*keys, "_hour"])]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_m{k}")) for k, c in enumerate([*keys, "_hour"])])
            rows = narrow.unionByName(earlier.join(mine, same, "left_semi"))
        new = run_summaries(rows, keys, "_hour", list(order_cols), failed_col).withColumn("_epoch", F.lit(epoch_id).cast("bigint"))
        new = new.select(*keys, "_hour", "n", "head", "tail", "longest", "_epoch")
        found.settle(epoch_id, new.schema)
        found.put(new, epoch_id)
        store.put(narrow, epoch_id)
    return run_epochs(events, sink, ckpt)


def alarm_table(spark: SparkSession, state_path: str, k: int, key_cols: list[str] = ("user_id",), key_type: str = "bigint") -> DataFrame:
    """Keys with their longest run so far; ``alarm`` from ``k`` on."""
    schema = T._parse_datatype_string(", ".join([*(f"`{c}` {key_type}" for c in key_cols), _SUMMARY]))
    rows = _summary_table(spark, state_path, list(key_cols)).rows(schema)
    folded = fold_summaries(_latest(list(key_cols))(rows), list(key_cols), "_hour")
    return folded.withColumn("alarm", F.col("max_run") >= k)
