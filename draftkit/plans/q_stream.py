"""Streaming queries (X): each runs a Structured Streaming query over a test
table with ``Trigger.AvailableNow`` into a sink under the checkpoint folder
and returns the sink read back; the SQL twin is the batch computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.functions.text import tokenize
from draftkit.plans import derived as D
from draftkit.plans import prepare as P
from draftkit.plans.catalog import register, table
from draftkit.plans.sqlgen import TOKEN_RE, scrape_cte, turn_tokens_ctes
from draftkit.streaming import keyed as K
from draftkit.streaming import streams as X


def _stream(spark, sf, name, files_per_batch: int | None = 1):
    """A table as a stream of its files: a folder of part files, or a single
    file (the pattern in the path lets the source take either)."""
    schema = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


@register("X1_stream_prompt_intake", """
SELECT doc_id::VARCHAR AS key, md5(text) AS prompt_md5 FROM documents
WHERE coalesce(length(trim(text)), 0) > 0 AND lang = 'en'""")
def x1(spark, sf):
    out, ck = X.scratch(spark, "x1-out"), X.scratch(spark, "x1-ck")
    X.run_available(X.prompt_intake(_stream(spark, sf, "documents"), "en", out, ck))
    return spark.read.parquet(out).select("key", F.md5("prompt").alias("prompt_md5"))


@register("X2_stream_dedup", """
SELECT DISTINCT event_id, user_id FROM events""")
def x2(spark, sf):
    s = _stream(spark, sf, "events").select("event_id", "user_id")
    doubled = s.unionByName(s)  # every row replayed once
    out, ck = X.scratch(spark, "x2-out"), X.scratch(spark, "x2-ck")
    X.run_available(X.dedup_table(doubled, ["event_id"], out, ck))
    return spark.read.parquet(out).drop("epoch")


@register("X3_stream_token_frequency", f"""
SELECT token, count(*)::BIGINT AS freq FROM (
  SELECT unnest(regexp_extract_all(coalesce(text, ''), {TOKEN_RE})) AS token FROM conversations WHERE role = 'assistant')
GROUP BY token""")
def x3(spark, sf):
    s = _stream(spark, sf, "conversations").filter(F.col("role") == "assistant")
    toks = s.select(F.explode(tokenize("text")).alias("token"))
    out, ck = X.scratch(spark, "x3-out"), X.scratch(spark, "x3-ck")
    X.run_available(X.running_token_frequency(toks, out, ck))
    return X.latest_counts(spark, out, ["token"])


@register("X4_stream_windowed_tallies", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS n_ok,
       count(*) FILTER (WHERE event_type = 'error')::BIGINT AS n_error
FROM events GROUP BY 1""")
def x4(spark, sf):
    s = _stream(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    out, ck = X.scratch(spark, "x4-out"), X.scratch(spark, "x4-ck")
    X.run_available(X.tally_table(s, "1 hour", out, ck))
    r = X.latest_counts(spark, out, ["window_start"], ["n_ok", "n_error"])
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_ok", "n_error")


REGISTRY_X5_SQL = """
WITH o AS (
  SELECT user_id, event_type = 'error' AS failed,
         sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
  FROM events),
runs AS (SELECT user_id, isl, count(*) AS len FROM o WHERE failed GROUP BY user_id, isl),
per AS (SELECT user_id, max(len) AS m FROM runs GROUP BY user_id)
SELECT u.user_id, coalesce(per.m, 0)::BIGINT AS max_fail_run, coalesce(per.m, 0) >= 3 AS alarm
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN per USING (user_id)"""


@register("X5_stream_failure_alarm", REGISTRY_X5_SQL)
def x5(spark, sf):
    """A micro-batch per file, in any order; each leaves the summaries of the
    hours it touches, and the result is folded from summaries alone."""
    s = _stream(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    state, ck = X.scratch(spark, "x5-state"), X.scratch(spark, "x5-ck")
    X.run_available(X.failure_alarm_tables(s, state, ck))
    return X.alarm_table(spark, state, 3).select("user_id", F.col("max_run").alias("max_fail_run"), "alarm")


@register("X5_stream_failure_alarm_tables", REGISTRY_X5_SQL)
def x5t(spark, sf):
    """The same under the name of the table form."""
    return x5(spark, sf)


@register("X5_stream_failure_alarm_state", REGISTRY_X5_SQL)
def x5s(spark, sf):
    """Keyed map state and event-time timers (``transformWithState``), a
    micro-batch per file, in any order within the delay."""
    s = _stream(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    out, ck = X.scratch(spark, "x5-updates"), X.scratch(spark, "x5-ck")
    X.run_available(_updates(K.failure_alarm_state(s, 3, "3650 days"), out, ck))
    return K.last_rows(spark.read.parquet(out), ["user_id"]).select("user_id", "max_fail_run", "alarm")


def _updates(frame, out, ck):
    """An update-mode stream, an epoch a folder."""
    sink = X.epoch_sink(out, lambda batch, earlier: batch, history=False)
    return frame.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ck).trigger(availableNow=True).start()


_X6_SQL = f"""
WITH {scrape_cte('sa')}, {scrape_cte('sb', "ts < TIMESTAMP '2024-01-15 00:00:00'")},
u AS (SELECT subset || '|' || name || '|' || coalesce(position::VARCHAR, '') AS series, 0 AS scrape, value FROM sb
      UNION ALL SELECT subset || '|' || name || '|' || coalesce(position::VARCHAR, ''), 1, value FROM sa)
SELECT series, scrape::BIGINT AS scrape, value,
       value - coalesce(lag(value) OVER (PARTITION BY series ORDER BY scrape), 0) AS delta FROM u"""


@register("X6_stream_counter_deltas_state", _X6_SQL)
def x6s(spark, sf):
    """The scrapes as files in no order: the later scrape first."""
    scr, src = _scrapes(spark, sf), X.scratch(spark, "x6-src")
    for k in (1, 0):
        scr.filter(F.col("scrape") == k).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(scr.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("scrape", F.col("scrape") + 1)
    out, ck = X.scratch(spark, "x6-updates"), X.scratch(spark, "x6-ck")
    X.run_available(_updates(K.counter_deltas_state(s, "1 day"), out, ck))
    last = K.last_rows(spark.read.parquet(out), ["series", "scrape"])
    return last.select("series", (F.col("scrape") - 1).alias("scrape"), "value", "delta")


def _scrapes(spark, sf):
    """Counter series of two scrapes, (series, scrape, value)."""
    series = F.concat_ws("|", "subset", "name", F.coalesce(F.col("position").cast("string"), F.lit("")))
    b = D._event_scrape(table(spark, sf, "events").filter(F.col("ts") < F.lit(D.BASELINE_INSTANT).cast("timestamp_ntz")))
    a = D.scrape(spark, sf)
    return (b.select(series.alias("series"), F.lit(0).cast("long").alias("scrape"), "value")
             .unionByName(a.select(series.alias("series"), F.lit(1).cast("long").alias("scrape"), "value")))


@register("X6_stream_counter_deltas", _X6_SQL)
def x6(spark, sf):
    scr, src = _scrapes(spark, sf), X.scratch(spark, "x6-src")
    scr.write.parquet(src)
    s = spark.readStream.schema(scr.schema).parquet(src)
    out, ck = X.scratch(spark, "x6-out"), X.scratch(spark, "x6-ck")
    q = (X.counter_deltas(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    X.run_available(q)
    return spark.read.parquet(out)


@register("X7_stream_incremental_build", f"""
WITH {turn_tokens_ctes('chatml', 8192)}
SELECT conv_id, count(*)::BIGINT AS seq_len, count(*) FILTER (WHERE trainable)::BIGINT AS n_trainable
FROM toks GROUP BY conv_id""")
def x7(spark, sf):
    def build(batch):
        t = P.corpus_tokens(batch, "chatml", 8192)
        return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("seq_len"),
                                        F.count_if("trainable").cast("bigint").alias("n_trainable"))
    store, out, ck = X.scratch(spark, "x7-turns"), X.scratch(spark, "x7-out"), X.scratch(spark, "x7-ck")
    X.run_available(X.incremental_build(_stream(spark, sf, "conversations"), build, store, out, ck))
    return X.latest_build(spark, out)
