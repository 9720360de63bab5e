"""Sampling, set operations, sharding, resume and work-queue bookkeeping."""

from __future__ import annotations

import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from draftkit.functions.index import dense_index, running_sum
from draftkit.functions.keys import order_key
from draftkit.functions.select import first_in_order
from draftkit.session import small_batches


# ------------------------------------------------------------ R1 - R4
def seeded_order(df: DataFrame, seed: int, id_col: str, out: str = "perm_idx") -> DataFrame:
    """A seeded permutation that does not depend on partitioning:
    position in ``md5(seed:id), id`` order (distributed dense index)."""
    return dense_index(df.withColumn("_h", order_key(seed, id_col)), ["_h", id_col], out).drop("_h")


def pre_cap(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """R2: keep the first ``3 * n`` rows of the seeded order (a no-op when
    smaller).  The cut is found on the hashes; the rows stay where they are."""
    return first_in_order(df.withColumn("_h", order_key(seed, id_col)), ["_h", id_col], 3 * n).drop("_h")


def concat_sources(*dfs: DataFrame) -> DataFrame:
    """UNION ALL in argument order with ``source_ord``."""
    tagged = [d.withColumn("source_ord", F.lit(i)) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def final_cap(df: DataFrame, n: int, seed: int, id_col: str, compat: bool = False) -> DataFrame:
    """First ``n`` rows.  ``compat=True`` keeps the early-sources-win
    order of the reference (its final shuffle discards its result);
    the default caps a real seeded shuffle."""
    d = df.withColumn("_h", order_key(seed, id_col))
    order = ["source_ord", "_h", id_col] if compat else ["_h", "source_ord", id_col]
    return first_in_order(d, order, n).drop("_h")


# ------------------------------------------------------------ R5 - R9
def regeneration_queue(prompts: DataFrame, done_keys: DataFrame | None, limit: int | None,
                       lang: str | None = None, key_col: str = "idx", prompt_col: str = "prompt",
                       lang_col: str = "lang") -> DataFrame:
    """R5 + R7: language filter, non-empty prompt, skip finished keys
    (``left_anti`` on the string key), then ``limit`` in key order."""
    d = prompts.filter(F.coalesce(F.length(F.trim(F.col(prompt_col))), F.lit(0)) > 0)
    if lang is not None:
        d = d.filter(F.col(lang_col) == lang)
    if done_keys is not None:
        d = d.withColumn("_k", F.col(key_col).cast("string")).join(
            done_keys.select(F.col("key").alias("_k")), "_k", "left_anti").drop("_k")
    if limit is not None:
        d = first_in_order(d, [key_col], limit)
    return d.orderBy(key_col)


def seen_keys(responses: DataFrame) -> DataFrame:
    """Finished keys of a response log: ``uuid``, else ``metadata.idx``,
    else ``id``; rows that failed to parse are ignored."""
    cols = responses.columns
    parts = []
    if "uuid" in cols:
        parts.append(F.col("uuid").cast("string"))
    if "metadata" in cols:
        parts.append(F.col("metadata.idx").cast("string"))
    if "idx" in cols:
        parts.append(F.col("idx").cast("string"))
    if "id" in cols:
        parts.append(F.col("id").cast("string"))
    d = responses
    if "_corrupt_record" in cols:
        d = d.filter(F.col("_corrupt_record").isNull())
    return d.select(F.coalesce(*parts).alias("key")).filter(F.col("key").isNotNull()).distinct()


def response_rows(df: DataFrame, idx_col: str, prompt_col: str, output_col: str,
                  finish_col: Column | None = None, latency_col: Column | None = None,
                  endpoint: str = "", reasoning_col: Column | None = None,
                  error_col: Column | None = None, uuid_col: str | None = None) -> DataFrame:
    """R8 (+ S7): one response record per row.  Error rows keep only the
    human turn and carry ``metadata.error``; ``id`` is the uuid or
    ``sample_{idx}``."""
    err = error_col if error_col is not None else F.lit(None).cast("string")
    human = F.struct(F.lit("human").alias("from"), F.col(prompt_col).alias("value"))
    gpt = F.struct(F.lit("gpt").alias("from"), F.col(output_col).alias("value"))
    convs = F.when(err.isNull(), F.array(human, gpt)).otherwise(F.array(human))
    rid = F.concat(F.lit("sample_"), F.col(idx_col).cast("string"))
    if uuid_col:
        rid = F.coalesce(F.col(uuid_col).cast("string"), rid)
    meta = F.struct(
        F.col(idx_col).cast("long").alias("idx"),
        (finish_col if finish_col is not None else F.lit(None).cast("string")).alias("finish_reason"),
        F.round(latency_col if latency_col is not None else F.lit(None).cast("double"), 3).alias("latency_s"),
        F.lit(endpoint).alias("endpoint"),
        (reasoning_col if reasoning_col is not None else F.lit(None).cast("string")).alias("reasoning_content"),
        err.alias("error"))
    return df.select(rid.alias("id"), convs.alias("conversations"), meta.alias("metadata"))


def outcome_tallies(df: DataFrame, error_col: str = "error", by: list[str] | None = None) -> DataFrame:
    """Ok / error counts."""
    g = df.groupBy(*(by or []))
    return g.agg(F.count_if(F.col(error_col).isNull()).cast("bigint").alias("n_ok"),
                 F.count_if(F.col(error_col).isNotNull()).cast("bigint").alias("n_error"))


# ------------------------------------------------------------ R10 - R13
def contiguous_split(df: DataFrame, ratio: float, idx_col: str = "sample_idx") -> DataFrame:
    """``r > 0`` keeps the first ``int(n*r)`` rows by dense index,
    ``r < 0`` keeps rows from ``int(n*(1+r))`` on, ``1.0`` keeps all."""
    if ratio == 1.0:
        return df
    if not (-1.0 < ratio < 1.0) or ratio == 0:
        raise ValueError("split ratio must be in (-1, 1] and non-zero")
    n = df.count()  # one scalar
    if ratio > 0:
        return df.filter(F.col(idx_col) < int(n * ratio))
    return df.filter(F.col(idx_col) >= int(n * (1.0 + ratio)))


def random_split(df: DataFrame, ratio: float, seed: int, id_col: str):
    """Seeded split by id: the first ``int(n*ratio)`` of the seeded
    order form the training part.  Returns (train, validation)."""
    ranked = seeded_order(df, seed, id_col, "_r")
    n = ranked.count()
    cut = int(n * ratio)
    return ranked.filter(F.col("_r") < cut).drop("_r"), ranked.filter(F.col("_r") >= cut).drop("_r")


def rank_of(idx: Column, target: int, world_size: int) -> Column:
    """Closed-form owner rank of dense index ``idx`` for balanced
    contiguous shards of ``target`` items (first ``target % W`` ranks get one
    more); NULL beyond ``target``."""
    c, rem = divmod(target, world_size)
    big = rem * (c + 1)
    r = F.when(idx < big, F.floor(idx / F.lit(c + 1)))
    if c > 0:
        r = r.otherwise(F.lit(rem) + F.floor((idx - F.lit(big)) / F.lit(c)))
    return F.when((idx >= 0) & (idx < target), r.cast("int"))


def shard_bounds(target: int, world_size: int, rank: int) -> tuple[int, int]:
    if not 0 <= rank < world_size:
        raise ValueError(f"rank {rank} outside [0, {world_size})")
    c, rem = divmod(target, world_size)
    start = rank * c + min(rank, rem)
    return start, start + c + (1 if rank < rem else 0)


def pending_for_rank(samples: DataFrame, existing: DataFrame, num_samples: int, max_samples: int | None,
                     world_size: int, rank: int, idx_col: str = "sample_idx") -> DataFrame:
    """This rank's contiguous shard minus the finished ids.  The cap
    ``min(max_samples, n)`` applies before removing finished ids."""
    target = min(max_samples, num_samples) if max_samples is not None else num_samples
    if target <= 0:
        return samples.limit(0)
    lo, hi = shard_bounds(target, world_size, rank)
    mine = samples.filter((F.col(idx_col) >= lo) & (F.col(idx_col) < hi))
    return mine.join(existing.select(F.col("idx").alias(idx_col)), idx_col, "left_anti")


# ------------------------------------------------------------ R14 - R17
def validate_features(samples: DataFrame, features: DataFrame, key: str = "sample_idx") -> DataFrame:
    """Join samples to feature records; status ``ok``,
    ``ids_mismatch`` or ``length_mismatch`` (``missing`` when absent)."""
    j = samples.select(key, "input_ids").join(features.select(key, "token_ids", "n_positions"), key, "left")
    status = (F.when(F.col("token_ids").isNull(), F.lit("missing"))
               .when(~F.col("input_ids").eqNullSafe(F.col("token_ids")), F.lit("ids_mismatch"))
               .when(F.col("n_positions") != F.size("token_ids"), F.lit("length_mismatch"))
               .otherwise(F.lit("ok")))
    return j.select(key, status.alias("status"))


MISSING_POLICIES = ("generate", "skip", "warn", "raise")


def missing_feature_policy(samples: DataFrame, features: DataFrame, policy: str, key: str) -> DataFrame:
    """Samples without a feature record are sent to generation, skipped,
    kept with a warning flag, or fail the job."""
    if policy not in MISSING_POLICIES:
        raise ValueError(f"unknown policy {policy}")
    f = features.select(key).distinct().withColumn("_has", F.lit(True))
    j = samples.join(f, key, "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    if policy == "skip":
        return j.filter("_has").withColumn("action", F.lit("load")).drop("_has")
    if policy == "raise":
        return j.withColumn("action", F.when(F.col("_has"), F.lit("load")).otherwise(
            F.raise_error(F.concat(F.lit("missing features for "), F.col(key).cast("string"))))).drop("_has")
    miss = "generate" if policy == "generate" else "load_warn"
    return j.withColumn("action", F.when(F.col("_has"), F.lit("load")).otherwise(F.lit(miss))).drop("_has")


def failure_runs(df: DataFrame, key_cols: list[str], order_cols: list[str], failed_col: str,
                 k: int, bucket: Column | None = None) -> DataFrame:
    """Gaps-and-islands on ordered outcomes; per key the longest run of
    consecutive failures and whether it reaches ``k`` (abort).

    A success resets the run.  Island id = running count of successes (a
    salted running sum, ``bucket`` e.g. the hour of ``ts``, so a key holding
    a large share of all rows is still split); a failure run is the set of
    failures sharing an island id, counted by a partial+final aggregate.
    """
    d = running_sum(df, key_cols, order_cols, F.when(F.col(failed_col), 0).otherwise(1), "_isl",
                    inclusive=True, bucket=bucket)
    runs = d.filter(F.col(failed_col)).groupBy(*key_cols, "_isl").agg(F.count(F.lit(1)).alias("_len"))
    per = runs.groupBy(*key_cols).agg(F.max("_len").cast("bigint").alias("max_fail_run"))
    base = df.select(*key_cols).distinct()
    return (base.join(per, key_cols, "left")
                .select(*key_cols, F.coalesce("max_fail_run", F.lit(0)).cast("bigint").alias("max_fail_run"))
                .withColumn("abort", F.col("max_fail_run") >= k))


# ------------------------------------------------------------ R18 / R19 / U6
class InvalidResponse(Exception):
    """Raised by a caller for a response that must not be retried."""


def call_with_retries(fn, item, retries: int = 3, base_delay: float = 2.0, sleep=time.sleep):
    """One attempt and up to ``retries`` more, after waits of
    ``base_delay``, twice that, and so on; ``InvalidResponse`` is never
    retried.  Returns (result, attempts, error)."""
    err = None
    for attempt in range(retries + 1):
        if attempt:
            sleep(base_delay * 2 ** (attempt - 1))
        try:
            return fn(item), attempt + 1, None
        except InvalidResponse as e:
            return None, attempt + 1, f"invalid response: {e}"
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {e}"
    return None, retries + 1, err


def bulk_call_batches(df: DataFrame, fn, out_col: str, out_type: str, inputs: list[str] | None = None) -> DataFrame:
    """Call ``fn(rows) -> [(result, attempts, error), ...]`` once per
    Arrow batch inside ``mapInArrow`` (partitions run in parallel on
    executors).  Batches are small (``session.small_batches``), and only the
    rows of one are Python objects.  ``rows`` are dicts of the ``inputs``
    columns (default: all); results must come in the same order."""
    small_batches(df.sparkSession)
    added = f"`{out_col}` {out_type}, attempts int, error string"
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])

    def run(batches):
        target = to_arrow_schema(schema)
        for batch in batches:
            res = fn((batch.select(inputs) if inputs else batch).to_pylist())
            if len(res) != batch.num_rows:
                raise ValueError("the call must return one result per row")
            fields = list(target)[batch.num_columns:]
            cols = [pa.array([r[k] for r in res], f.type, from_pandas=True) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=pa.schema([*batch.schema, *fields]))
    return df.mapInArrow(run, schema)


def bulk_call(df: DataFrame, fn, out_col: str, out_type: str, retries: int = 3,
              base_delay: float = 2.0) -> DataFrame:
    """U6 + R18: one call per row with retries, on top of the batch form."""
    return bulk_call_batches(df, lambda rows: [call_with_retries(fn, row, retries, base_delay) for row in rows], out_col, out_type)


#: Rows of an output batch of the windowed call, so that finished rows don't
#: wait for a whole input batch.
CALL_ROWS = 64


def bulk_call_window(df: DataFrame, fn, out_col: str, out_type: str, concurrency: int = 8, retries: int = 3, base_delay: float = 2.0,
                     stop_after: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """U6 + R18 + R17: ``fn(row)`` with up to ``concurrency`` calls of a task
    in flight at once (threads; the calls wait for a server, not for this
    machine), results in the order of the rows, a batch of CALL_ROWS given on
    as soon as its rows are done.  A window of ``concurrency`` rows slides over
    the partition: a row's call starts when the one ``concurrency`` rows before
    it is done, so no more rows than that are held.

    ``stop_after`` consecutive failures (in row order, after retries) are a
    server that is gone: no further call starts; calls in flight are still
    taken.  With ``scope`` columns, by which each partition must be sorted,
    runs of failures begin anew, and calls start again, with every new value.

    Adds ``out_col``, ``attempts``, ``error`` (``not attempted`` where no call
    was made), ``attempted`` and ``stopped`` (the row whose failure was the
    last straw).  An ``fn`` with a method ``start`` has it called once in
    every task."""
    small_batches(df.sparkSession)
    scope = list(scope or [])
    added = [f"`{out_col}` {out_type}", "attempts int", "error string", "attempted boolean", "stopped boolean"]
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(added)).fields])

    def run(batches):
        target = to_arrow_schema(schema)
        if hasattr(fn, "start"):
            fn.start()
        window, results, waiting = deque(), [], deque()
        state = {"scope": None, "fails": 0, "open": True}

        def take():
            """The oldest row's result, and what it says of the server."""
            at, job = window.popleft()
            if at != state["scope"]:
                state.update(scope=at, fails=0, open=True)
            value, attempts, error = job.result() if job else (None, 0, "not attempted")
            stopped = False
            if job:
                state["fails"] = state["fails"] + 1 if error else 0
                if stop_after and state["open"] and state["fails"] >= stop_after:
                    state["open"], stopped = False, True
            results.append((value, attempts, error, job is not None, stopped))

        def ready(everything):
            while waiting and (everything or len(results) >= waiting[0].num_rows):
                part = waiting.popleft()
                got, results[:part.num_rows] = results[:part.num_rows], []
                cols = [pa.array([r[k] for r in got], target.field(part.num_columns + k).type) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], schema=pa.schema([*part.schema, *list(target)[part.num_columns:]]))

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for a in range(0, batch.num_rows, CALL_ROWS):
                    part = batch.slice(a, CALL_ROWS)
                    waiting.append(part)
                    for row in part.to_pylist():
                        if len(window) == concurrency:
                            take()
                        at = tuple(row[c] for c in scope)
                        go = state["open"] or at != state["scope"]
                        window.append((at, pool.submit(call_with_retries, fn, row, retries, base_delay) if go else None))
                    yield from ready(False)
            while window:
                take()
            yield from ready(True)

    return df.mapInArrow(run, schema)


def response_integrity(df: DataFrame, request_col: str = "prompt_token_ids",
                       response_col: str = "response_prompt_ids", transfer_col: str | None = None) -> DataFrame:
    """The echoed prompt ids must be present and equal to the request,
    and with ``transfer_col`` the record of where the features went must be
    there."""
    reason = (F.when(F.col(response_col).isNull(), F.lit("missing prompt ids"))
               .when(~F.col(request_col).eqNullSafe(F.col(response_col)), F.lit("prompt ids differ")))
    if transfer_col:
        reason = reason.when(F.col(transfer_col).isNull(), F.lit("missing transfer record"))
    return df.withColumn("integrity_error", reason)


def feature_sink(df: DataFrame, path: str, cache: bool) -> None:
    """Persist generated features (cache) or discard them after use."""
    if cache:
        df.write.mode("append").parquet(path)

