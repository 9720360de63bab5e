"""Queries for operators that the other modules use but don't register by
themselves: the JSON-to-samples plan, file scans end to end, casts, policies
and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.functions.text import tokenize
from draftkit.operators import evals as E
from draftkit.operators import metrics as M
from draftkit.operators import sample as R
from draftkit.operators import shape as Q
from draftkit.operators import vocab as V
from draftkit.plans import derived as D
from draftkit.plans import prepare as P
from draftkit.plans.catalog import register, round6, table
from draftkit.plans.q_evals import _SWEEP_SQL, _bench_docs
from draftkit.plans.q_metrics import _LOGIT
from draftkit.plans.q_prepare import _FREQ_CTE, DRAFT_K, MAXLEN, TARGET_V, join_ints
from draftkit.plans.sqlgen import TOKEN_RE, argmax_sql, hx, role_case, round6_sql, turn_tokens_ctes
from draftkit.sources import readers as S
from draftkit.sources import sinks as SK
from draftkit.streaming.streams import scratch

SEED = 42

# two sources: even conversations as from/value, odd ones as role/content
_CHAT_SQL = f"""
WITH raw AS (
  SELECT CASE conv_id % 2 WHEN 0 THEN 'even:' ELSE 'odd:' END || conv_id::VARCHAR AS conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS len FROM conversations),
drawn AS (SELECT *, 1 + {hx(f"'{SEED}:' || conv_id")} % len AS n FROM raw),
cut AS (SELECT conv_id, min(i) AS cut FROM drawn WHERE {role_case('role')} = 'assistant' AND i + 1 >= n GROUP BY conv_id),
chat AS (SELECT d.conv_id, d.turn, d.role, d.text FROM drawn d LEFT JOIN cut USING (conv_id) WHERE cut.cut IS NULL OR d.i <= cut.cut),
{turn_tokens_ctes('chatml', 512, 'chat')},
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM toks GROUP BY token))
SELECT split_part(conv_id, ':', 1) AS source, split_part(conv_id, ':', 2) AS source_id,
       string_agg(v.token_id::VARCHAR, ',' ORDER BY pos) AS input_ids,
       string_agg(CASE WHEN trainable THEN 'true' ELSE 'false' END, ',' ORDER BY pos) AS loss_mask, count(*)::BIGINT AS seq_len
FROM toks JOIN vocab v USING (token) GROUP BY conv_id
HAVING count(*) FILTER (WHERE trainable) >= 5"""


@register("S1_N5_T9_json_to_prepared", _CHAT_SQL)
def json_to_prepared(spark, sf):
    """Two chat files of different key styles, written as JSON lines, read,
    normalised with turn dropout, rendered, tokenised, masked, cut at 512
    tokens and numbered as one plan."""
    c = table(spark, sf, "conversations")
    sources = {}
    for k, (name, keys, column) in enumerate((("even", ("from", "value"), "conversations"), ("odd", ("role", "content"), "messages"))):
        turn = F.struct(F.col("role").alias(keys[0]), F.col("text").alias(keys[1]))
        rows = c.filter(F.col("conv_id") % 2 == k).groupBy(F.col("conv_id").cast("string").alias("id")).agg(
            F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("s"))
        path = scratch(spark, f"chat-{name}") + ".jsonl"
        rows.select("id", F.transform("s", lambda x: x["t"]).alias(column)).write.json(path)
        sources[name] = S.read_conversations(spark, path)
    out = P.prepare_datasets(sources, "chatml", 512, minimum_valid_tokens=5, dropout_seed=SEED)
    return out.select("source", "source_id", join_ints("input_ids").alias("input_ids"), join_ints("loss_mask").alias("loss_mask"),
                      F.col("seq_len").cast("bigint").alias("seq_len"))


# ------------------------------------------------------------------ S6, S11, S13
def _response_log(spark, d):
    """Responses of ``d`` appended to a JSON-lines log twice (a failed and a
    finished run), read back as the finished keys."""
    rows = R.response_rows(d, "doc_id", "text", "lang", uuid_col="doc_id")
    out = scratch(spark, "responses")
    SK.append_jsonl(rows, out)
    SK.append_jsonl(R.response_rows(d, "doc_id", "text", "lang", error_col=F.lit("timeout"), uuid_col="doc_id"), out)
    log = spark.read.schema(rows.schema).json(out)
    per = log.groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return R.seen_keys(log.select("id")).join(per, "key")


@register("S6_R6_response_log", """
SELECT doc_id::VARCHAR AS key, (2 * count(*))::BIGINT AS n_rows FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id""")
def s6(spark, sf):
    """The log of all documents by run ids: a failed and a finished run, each
    made twice, and one that was cut short before its commit."""
    d, out = table(spark, sf, "documents"), scratch(spark, "response-runs")
    good = R.response_rows(d, "doc_id", "text", "lang", uuid_col="doc_id")
    bad = R.response_rows(d, "doc_id", "text", "lang", error_col=F.lit("timeout"), uuid_col="doc_id")
    good.limit(10).write.json(f"{out}/run=finished/cut-short")
    wrote = [SK.append_jsonl(rows, out, run_id) for rows, run_id in ((bad, "failed"), (good, "finished"), (good, "finished"), (bad, "failed"))]
    if wrote != [True, True, False, False]:
        raise ValueError("a run was written twice")
    log = SK.read_jsonl_runs(spark, out, good.schema)
    per = log.groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return R.seen_keys(log.select("id")).join(per, "key")


@register("S6_R6_response_log_all", """
SELECT doc_id::VARCHAR AS key, (2 * count(*))::BIGINT AS n_rows FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id""")
def s6_all(spark, sf):
    """The log of all documents; rows that repeat a doc_id add to its key, and
    rows without one are written but have no key."""
    return _response_log(spark, table(spark, sf, "documents"))


@register("S11_recursive_listing", "SELECT DISTINCT lang, 'hs_' || lang || '.txt' AS name FROM documents")
def s11(spark, sf):
    """Files two folders down, found by the recursive listing (contents
    pruned)."""
    base = scratch(spark, "listing")
    names = table(spark, sf, "documents").select("lang").distinct()
    names.select(F.concat(F.lit("hs_"), "lang", F.lit(".txt")).alias("value"), F.col("lang").alias("a"), F.lit("x").alias("b")).write.partitionBy("a", "b").text(base)
    files = S.list_files(spark, base, glob="part-*", recursive=True).select(F.regexp_extract("path", "a=([^/]+)/b=x/", 1).alias("lang"), "length")
    return files.filter(F.col("length") > 0).select("lang", F.concat(F.lit("hs_"), "lang", F.lit(".txt")).alias("name")).distinct()


@register("S13_benchmark_json_files", f"""
WITH {_SWEEP_SQL}
SELECT subset, strategy, target_rate, rps_median, {round6_sql('latency_median_s')} AS latency_median_s, total_output_tokens FROM sw""")
def s13(spark, sf):
    """Benchmark documents written as JSON files, one per subset, and scanned
    again from the files."""
    docs = _bench_docs(spark, sf).groupBy(E.subset_from_filename(F.col("file")).alias("f")).agg(
        F.collect_list(F.struct("config", "metrics")).alias("benchmarks"))
    path = scratch(spark, "bench-json")
    docs.repartition("f").write.partitionBy("f").json(path)
    got = S.read_benchmark_json(spark, path)
    got = got.withColumn("file", F.concat(F.lit("sweep_"), F.regexp_extract("file", "f=([^/]+)/", 1), F.lit(".json")))
    s = E.sweep_rows(got, E.subset_from_filename(F.col("file")))
    return s.select("subset", "strategy", "target_rate", "rps_median", round6(F.col("latency_median_s")).alias("latency_median_s"), "total_output_tokens")


# ------------------------------------------------------------------ Q7, Q9
@register("Q7_Q9_mtp_view_cast", "SELECT vec_id, embedding[1]::FLOAT::DOUBLE AS h0, len(embedding)::BIGINT AS dim, 'array<float>' AS kind FROM embeddings")
def q7(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("verifier_last_hidden_states"))
    v = Q.cast_hidden(Q.mtp_view(e))
    return v.select("vec_id", F.col("hidden_states_last")[0].cast("double").alias("h0"), F.size("hidden_states_last").cast("bigint").alias("dim"),
                    F.lit(v.schema["hidden_states_last"].dataType.simpleString()).alias("kind"))


# ------------------------------------------------------------------ R15, R20
_LOGGED = f"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, {TOKEN_RE}) AS ids FROM documents)"""


@register("R15_R20_feature_records", _LOGGED + """
SELECT doc_id AS sample_idx, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'length_mismatch' ELSE 'ok' END AS status FROM s""")
def r15(spark, sf):
    """Features generated in two runs (cached: appended to the store) and
    validated when they are loaded; a run that discards leaves nothing."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_idx"), F.transform(tokenize("text"), lambda t: F.hash(t)).alias("input_ids"))
    made = d.select("sample_idx", F.col("input_ids").alias("token_ids"),
                    (F.size("input_ids") + F.when(F.col("sample_idx") % 5 == 1, 1).otherwise(0)).alias("n_positions"))
    store = scratch(spark, "features")
    R.feature_sink(made.filter(F.col("sample_idx") % 5 < 3), store, cache=True)
    R.feature_sink(made.filter(F.col("sample_idx") % 5 >= 3), store, cache=True)
    R.feature_sink(made, store, cache=False)
    kept = spark.read.parquet(store).filter(F.col("sample_idx") % 5 != 0)
    return R.validate_features(d, kept, "sample_idx")


# ------------------------------------------------------------------ M15
@register("M15_loss_by_name", _LOGIT + f""",
v AS (SELECT vec_id, unnest(['kl_div', 'ce']) AS name, list_sum(list_transform(generate_series(1, len(target)),
        lambda i: exp(target[i] - lt) * ((target[i] - lt) - (draft[i] - ld)))) AS kl, ld - draft[{argmax_sql('target')} + 1] AS ce FROM l)
SELECT vec_id, name, {round6_sql("CASE name WHEN 'ce' THEN ce ELSE kl END")} AS loss FROM v""")
def m15(spark, sf):
    p = D.logit_pairs(spark, sf)
    losses = F.array(*[F.struct(F.lit(n).alias("name"), M.loss_by_name(n)(F.col("draft"), F.col("target")).alias("loss")) for n in ("kl_div", "ce")])
    return p.select("vec_id", F.inline(losses)).select("vec_id", "name", round6(F.col("loss")).alias("loss"))


# ------------------------------------------------------------------ V9, V10
@register("V9_V10_resolved_maps", _FREQ_CTE + f""",
sel AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT {DRAFT_K})
SELECT how, (row_number() OVER (PARTITION BY how ORDER BY token_id) - 1)::BIGINT AS draft_id, token_id::BIGINT AS target_id,
       (token_id - (row_number() OVER (PARTITION BY how ORDER BY token_id) - 1))::BIGINT AS "offset"
FROM sel, (SELECT unnest(['rebuild', 'cached']) AS how)""")
def v9(spark, sf):
    """Maps rebuilt from a frequency table where none are cached, then loaded
    from the cache that the rebuild left."""
    freq, cache = scratch(spark, "v9-freq"), scratch(spark, "v9-maps")
    SK.write_token_frequency(V.token_frequency(P.prepared_samples(table(spark, sf, "conversations"), "chatml", MAXLEN)), freq)
    size = V.target_vocab_size(TARGET_V, None)
    out = None
    for want in ("rebuild", "cached"):
        how, d2t, _t2d = V.load_maps(spark, None, None, cache, freq, DRAFT_K, size)
        assert how == want
        d = d2t.select(F.lit(how).alias("how"), "draft_id", "target_id", "offset")
        out = d if out is None else out.unionByName(d)
    return out
