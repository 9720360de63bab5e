"""Stand-in inputs derived from the test tables (FIXTURES part C).

These only give rows in the schema an operator expects (prepared samples,
counter scrapes, logits, sweep points, metric logs); the operators do the
work.  Each has a DuckDB twin in ``plans/sqlgen.py`` built from the same
expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftkit.operators.evals import N_ACCEPTED, N_DRAFT_TOKENS, N_DRAFTS, N_PER_POS
from draftkit.plans import prepare as P
from draftkit.plans.tables import table

HASH_VOCAB = 50000
SAMPLE_MAXLEN = 8192  # the reference's default sequence length
BASELINE_INSTANT = "2024-01-15 00:00:00"


def token_id(token) -> F.Column:
    """Hashed token id (stand-in for a tokenizer vocabulary)."""
    return (F.conv(F.substring(F.md5(token), 1, 6), 16, 10).cast("bigint") % HASH_VOCAB).cast("int")


def sample_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Long-form prepared samples ``(sample_idx, pos, token, mask)``."""
    t = P.corpus_tokens(table(spark, sf, "conversations"), "chatml", SAMPLE_MAXLEN)
    return t.select(F.col("conv_id").alias("sample_idx"), "pos", token_id(F.col("token")).alias("token"),
                    F.col("trainable").alias("mask"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared samples ``(sample_idx, input_ids, loss_mask, seq_len)``."""
    g = sample_tokens(spark, sf).groupBy("sample_idx").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "mask"))).alias("_t"))
    return g.select("sample_idx", F.transform("_t", lambda x: x["token"]).alias("input_ids"),
                    F.transform("_t", lambda x: x["mask"]).alias("loss_mask"),
                    F.size("_t").alias("seq_len"))


def _event_scrape(events: DataFrame) -> DataFrame:
    a = (F.floor(F.col("value")).cast("bigint") % 4)
    g = events.groupBy(F.col("event_type").alias("subset")).agg(
        F.count(F.lit(1)).cast("double").alias("d"), F.sum(a).cast("double").alias("acc"),
        *[F.count_if(a > i).cast("double").alias(f"p{i}") for i in range(3)])
    scal = g.select("subset", F.explode(F.array(
        F.struct(F.lit(N_DRAFTS).alias("name"), F.lit(None).cast("int").alias("position"), F.col("d").alias("value")),
        F.struct(F.lit(N_DRAFT_TOKENS).alias("name"), F.lit(None).cast("int").alias("position"), (F.col("d") * 3).alias("value")),
        F.struct(F.lit(N_ACCEPTED).alias("name"), F.lit(None).cast("int").alias("position"), F.col("acc").alias("value")),
        *[F.struct(F.lit(N_PER_POS).alias("name"), F.lit(i).alias("position"), F.col(f"p{i}").alias("value"))
          for i in range(3)])).alias("r")).select("subset", "r.*")
    return scal


def scrape(spark: SparkSession, sf: str) -> DataFrame:
    """Counter scrape after the run, long form ``(subset, name, position, value)``."""
    return _event_scrape(table(spark, sf, "events"))


def baseline_scrape(spark: SparkSession, sf: str) -> DataFrame:
    """Scrape before the run: events before a fixed instant; position 2 of
    subset ``view`` missing (exercises the zero-extension)."""
    ev = table(spark, sf, "events").filter(F.col("ts") < F.lit(BASELINE_INSTANT).cast("timestamp_ntz"))
    s = _event_scrape(ev)
    return s.filter(~((F.col("subset") == "view") & F.col("position").eqNullSafe(2)))


def counter_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Counter exposition text per subset: ``name_total{engine="0",...} v``
    lines plus a comment, a foreign counter, a ``NaN`` line and a duplicate
    per-position line from a second engine with a smaller value (all lines
    from one pass over the scrape rows)."""
    s = scrape(spark, sf)
    pos = F.col("position").cast("string")
    main = F.concat(F.col("name"), F.lit("_total{"), F.when(F.col("position").isNull(), F.lit('engine="0"')).otherwise(
        F.concat(F.lit('engine="0",position="'), pos, F.lit('"'))), F.lit("} "), F.col("value").cast("bigint").cast("string"))
    dup = F.concat(F.col("name"), F.lit('_total{engine="1",position="'), pos, F.lit('"} '),
                   F.floor(F.col("value") / 2).cast("bigint").cast("string"))
    extra = [F.lit("# HELP vllm:spec_decode_num_drafts Number of drafts."), F.lit("process_cpu_seconds_total 12.5"),
             F.lit('vllm:spec_decode_num_drafts_total{engine="2"} NaN'), F.lit("")]
    lines = (F.when(F.col("position").isNotNull(), F.array(main, dup))
              .when(F.col("name") == N_DRAFTS, F.array(main, *extra))
              .otherwise(F.array(main)))
    return s.select("subset", F.explode(lines).alias("value"))


def logit_pairs(spark: SparkSession, sf: str, lag: int = 1) -> DataFrame:
    """Draft logits = embedding ``v``, target logits = embedding ``v+lag``."""
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", "label", F.col("embedding").alias("draft"))
    b = e.select((F.col("vec_id") - lag).alias("vec_id"), F.col("embedding").alias("target"))
    return a.join(b, "vec_id")


def lagged_logits(spark: SparkSession, sf: str, steps: int) -> DataFrame:
    """``(step, draft, target)``: embedding ``v`` beside embedding
    ``v + step + 1``, for all steps in one join on the id."""
    e = table(spark, sf, "embeddings")
    sent = e.select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), "vec_id", F.col("embedding").alias("target"))
    sent = sent.select("step", (F.col("vec_id") - F.col("step") - 1).alias("vec_id"), "target")
    return e.select("vec_id", F.col("embedding").alias("draft")).join(sent, "vec_id").select("step", "draft", "target")


def prediction_steps(spark: SparkSession, sf: str, steps: int = 3, seed: int = 42) -> DataFrame:
    """Per (sample, pos) an array over steps of ``(step, target, mask, pred,
    draw)``: target = token at ``pos + step`` (steps past the end fall away),
    prediction = target when the keyed draw mod 4 > 0, else target + 1.
    Built inside the sample's row, without a join."""
    def at(pos, k):
        target = F.get("input_ids", pos + F.lit(k))
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_idx").cast("string"),
                                                    pos.cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("bigint")
        return F.struct(F.lit(k).alias("step"), target.alias("target"), F.get("loss_mask", pos + F.lit(k)).alias("mask"),
                        F.when(draw % 4 > 0, target).otherwise(target + 1).alias("pred"), draw.alias("draw"))
    places = F.transform("input_ids", lambda _t, pos: F.struct(
        pos.cast("bigint").alias("pos"), F.filter(F.array(*[at(pos, k) for k in range(steps)]), lambda x: x["target"].isNotNull()).alias("s")))
    return samples(spark, sf).select("sample_idx", F.explode(places).alias("p")).select("sample_idx", "p.pos", "p.s")


def predictions(spark: SparkSession, sf: str, steps: int = 3, seed: int = 42) -> DataFrame:
    """``prediction_steps`` in long form, one row per (sample, pos, step)."""
    return prediction_steps(spark, sf, steps, seed).select("sample_idx", "pos", F.inline("s"))


def draw_logits(draw) -> tuple:
    """Draft and target logits (four each) of a keyed draw."""
    pick = lambda shift: F.shiftright(draw, shift).bitwiseAND(F.lit(15)).cast("double") / 4
    return F.array(*[pick(8 * i) for i in range(4)]), F.array(*[pick(8 * i + 4) for i in range(4)])


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training-metric log ``(epoch, batch, name, value)``: epoch = day of
    ``ts``, batch = hour; per event type ``x_sum`` and ``x_total``, plus one
    unpaired metric ``lr``."""
    ev = table(spark, sf, "events")
    epoch = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    g = ev.groupBy(epoch.alias("epoch"), F.hour("ts").alias("batch"), "event_type").agg(
        F.sum("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    sums = g.select("epoch", "batch", F.concat(F.col("event_type"), F.lit("_sum")).alias("name"), F.col("s").alias("value"))
    tots = g.select("epoch", "batch", F.concat(F.col("event_type"), F.lit("_total")).alias("name"), F.col("n").alias("value"))
    lr = ev.groupBy(epoch.alias("epoch"), F.hour("ts").alias("batch")).agg(F.avg("value").alias("value")).withColumn(
        "name", F.lit("lr"))
    return sums.unionByName(tots).unionByName(lr.select("epoch", "batch", "name", "value"))


def sweep_points(spark: SparkSession, sf: str) -> DataFrame:
    """Sweep rows per (label, subset, hour): label = ``user_id % 2``, subset
    = ``run_`` + event type, strategy ``constant`` (``throughput`` for the
    first hour), x = events in the hour, y = median value."""
    ev = table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts"))
    g = ev.groupBy((F.col("user_id") % 2).cast("string").alias("label"), F.col("event_type"), hour.alias("h")).agg(
        F.count(F.lit(1)).cast("double").alias("rps_median"), F.median("value").alias("latency_median_s"))
    return g.select("label", F.concat(F.lit("run_"), F.col("event_type")).alias("subset"),
                    F.when(F.hour("h") == 0, F.lit("throughput")).otherwise(F.lit("constant")).alias("strategy"),
                    F.col("rps_median").cast("string").alias("rps_median"),
                    F.col("latency_median_s").cast("string").alias("latency_median_s"))
