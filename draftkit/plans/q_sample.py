"""Queries for sampling, sharding, resume (R) and sources/sinks (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.functions.index import dense_index
from draftkit.functions.text import tokenize
from draftkit.operators import normalize as N
from draftkit.operators import sample as R
from draftkit.operators.evals import max_tokens_for
from draftkit.plans.catalog import register, table
from draftkit.plans.sqlgen import TOKEN_RE
from draftkit.sources import readers as S
from draftkit.sources import sinks as SK

SEED = 42


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _h(col: str, seed=SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', {col}::VARCHAR))"


@register("R1_seeded_order", f"""
SELECT doc_id, (row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) - 1)::BIGINT AS perm_idx FROM documents""")
def r1(spark, sf):
    return R.seeded_order(_docs(spark, sf).select("doc_id"), SEED, "doc_id")


@register("R2_pre_cap", f"""
SELECT doc_id FROM documents ORDER BY {_h('doc_id')}, doc_id LIMIT 300""")
def r2(spark, sf):
    return R.pre_cap(_docs(spark, sf).select("doc_id"), 100, SEED, "doc_id")


_SRC_SQL = """
src AS (
  SELECT doc_id AS id, text, 0 AS source_ord FROM documents
  UNION ALL SELECT item_id AS id, text, 1 AS source_ord FROM benchmark)"""


def _sources(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.concat_sources(d, b)


@register("R3_concat_sources", f"WITH {_SRC_SQL} SELECT id, source_ord::BIGINT AS source_ord, length(text)::BIGINT AS n_chars FROM src")
def r3(spark, sf):
    return _sources(spark, sf).select("id", "source_ord", F.length("text").cast("bigint").alias("n_chars"))


@register("R4_final_cap_compat", f"""
WITH {_SRC_SQL}
SELECT id, source_ord::BIGINT AS source_ord FROM src ORDER BY source_ord, {_h('id')}, id LIMIT 500""")
def r4c(spark, sf):
    return R.final_cap(_sources(spark, sf), 500, SEED, "id", compat=True).select("id", "source_ord")


@register("R4_final_cap_shuffled", f"""
WITH {_SRC_SQL}
SELECT id, source_ord::BIGINT AS source_ord FROM src ORDER BY {_h('id')}, source_ord, id LIMIT 500""")
def r4s(spark, sf):
    return R.final_cap(_sources(spark, sf), 500, SEED, "id", compat=False).select("id", "source_ord")


@register("R5_regeneration_queue", """
SELECT doc_id FROM documents
WHERE coalesce(length(trim(text)), 0) > 0 AND lang = 'en'
  AND doc_id::VARCHAR NOT IN (SELECT doc_id::VARCHAR FROM labels)
ORDER BY doc_id LIMIT 200""")
def r5(spark, sf):
    p = _docs(spark, sf).select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"), "lang")
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return R.regeneration_queue(p, done, 200, lang="en").select(F.col("idx").alias("doc_id"))


@register("R6_seen_keys", """
SELECT DISTINCT doc_id::VARCHAR AS key FROM labels""")
def r6(spark, sf):
    # response log rows as the writer stores them: metadata.idx and id
    lab = table(spark, sf, "labels")
    resp = lab.select(F.concat(F.lit("sample_"), F.col("doc_id").cast("string")).alias("id"),
                      F.struct(F.col("doc_id").alias("idx")).alias("metadata"))
    return R.seen_keys(resp)


@register("R7_resume_anti_join", """
SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id::VARCHAR FROM labels)""")
def r7(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))
    p = _docs(spark, sf).select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"))
    return R.regeneration_queue(p, done, None).select(F.col("idx").alias("doc_id"))


_PAIRS_SQL = """
pr AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def _pairs(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("output"))
    return u.join(a, ["conv_id", "turn"]).withColumn("idx", F.col("conv_id") * 1000 + F.col("turn"))


@register("R8_response_rows", f"""
WITH {_PAIRS_SQL}
SELECT 'sample_' || (conv_id * 1000 + turn)::VARCHAR AS id, 2::BIGINT AS n_turns,
       md5(prompt) AS human_md5, md5(output) AS gpt_md5, (conv_id * 1000 + turn)::BIGINT AS idx,
       'stop' AS finish_reason
FROM pr""")
def r8(spark, sf):
    r = R.response_rows(_pairs(spark, sf), "idx", "prompt", "output", finish_col=F.lit("stop"))
    return r.select("id", F.size("conversations").cast("bigint").alias("n_turns"),
                    F.md5(F.col("conversations")[0]["value"]).alias("human_md5"),
                    F.md5(F.col("conversations")[1]["value"]).alias("gpt_md5"),
                    F.col("metadata.idx").alias("idx"), F.col("metadata.finish_reason").alias("finish_reason"))


@register("S7_error_rows", """
SELECT 'sample_' || event_id::VARCHAR AS id,
       CASE WHEN event_type = 'error' THEN 1 ELSE 2 END::BIGINT AS n_turns,
       CASE WHEN event_type = 'error' THEN 'request failed: ' || props END AS error
FROM events""")
def s7(spark, sf):
    ev = table(spark, sf, "events")
    err = F.when(F.col("event_type") == "error", F.concat(F.lit("request failed: "), F.col("props")))
    r = R.response_rows(ev, "event_id", "props", "event_type", error_col=err)
    return r.select("id", F.size("conversations").cast("bigint").alias("n_turns"), F.col("metadata.error").alias("error"))


@register("R9_outcome_tallies", """
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS n_ok,
       count(*) FILTER (WHERE event_type = 'error')::BIGINT AS n_error
FROM events GROUP BY user_id""")
def r9(spark, sf):
    ev = table(spark, sf, "events").withColumn("error", F.when(F.col("event_type") == "error", F.lit("failed")))
    return R.outcome_tallies(ev, "error", ["user_id"])


def _indexed_docs(spark, sf):
    return dense_index(_docs(spark, sf).select("doc_id"), ["doc_id"], "sample_idx")


@register("R10_split_train", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM d WHERE idx < floor(n * 0.9)""")
def r10t(spark, sf):
    return R.contiguous_split(_indexed_docs(spark, sf), 0.9).select("doc_id")


@register("R10_split_validation", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM d WHERE idx >= floor(n * (1 - 0.1))""")
def r10v(spark, sf):
    return R.contiguous_split(_indexed_docs(spark, sf), -0.1).select("doc_id")


@register("R11_random_split", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) - 1 AS r,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id FROM d WHERE r < floor(n * 0.9)""")
def r11(spark, sf):
    train, _val = R.random_split(_docs(spark, sf).select("doc_id"), 0.9, SEED, "doc_id")
    return train


@register("R11_random_split_validation", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) - 1 AS r,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id FROM d WHERE r >= floor(n * 0.9)""")
def r11v(spark, sf):
    return R.random_split(_docs(spark, sf).select("doc_id"), 0.9, SEED, "doc_id")[1]


@register("R12_rank_shards", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
p AS (SELECT *, n // 3 AS c, n % 3 AS rem FROM d)
SELECT doc_id, (CASE WHEN idx < rem * (c + 1) THEN idx // (c + 1)
                     ELSE rem + (idx - rem * (c + 1)) // c END)::BIGINT AS rank
FROM p""")
def r12(spark, sf):
    d = _indexed_docs(spark, sf)
    n = d.count()
    return d.select("doc_id", R.rank_of(F.col("sample_idx"), n, 3).alias("rank"))


@register("R13_pending_for_rank", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
p AS (SELECT *, least(n, 700) AS t FROM d),
b AS (SELECT *, 1 * (t // 3) + least(1, t % 3) AS lo,
             1 * (t // 3) + least(1, t % 3) + t // 3 + CASE WHEN 1 < t % 3 THEN 1 ELSE 0 END AS hi FROM p)
SELECT idx::BIGINT AS sample_idx FROM b
WHERE idx >= lo AND idx < hi AND idx NOT IN (SELECT doc_id FROM labels)""")
def r13(spark, sf):
    d = _indexed_docs(spark, sf)
    n = d.count()
    existing = table(spark, sf, "labels").select(F.col("doc_id").alias("idx"))
    return R.pending_for_rank(d, existing, n, 700, 3, 1).select("sample_idx")


_FEAT_SQL = f"""
st AS (
  SELECT d.doc_id, regexp_extract_all(d.text, {TOKEN_RE}) AS toks, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT doc_id, toks AS input_ids, quality, toxic FROM st),
f AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN list_reverse(input_ids) ELSE input_ids END AS token_ids,
         len(input_ids) + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS n_positions
  FROM s WHERE quality IS NOT NULL)"""


def _features(spark, sf):
    d = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    s = d.select(F.col("doc_id").alias("sample_idx"), tokenize("text").alias("input_ids"),
                 "quality", "toxic")
    f = s.filter(F.col("quality").isNotNull()).select(
        "sample_idx", F.when(F.col("toxic") == 1, F.reverse("input_ids")).otherwise(F.col("input_ids")).alias("token_ids"),
        (F.size("input_ids") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("n_positions"))
    return s.select("sample_idx", "input_ids"), f


@register("R14_validate_features", f"""
WITH {_FEAT_SQL}
SELECT s.doc_id AS sample_idx,
       CASE WHEN f.token_ids IS NULL THEN 'missing'
            WHEN s.input_ids IS DISTINCT FROM f.token_ids THEN 'ids_mismatch'
            WHEN f.n_positions <> len(f.token_ids) THEN 'length_mismatch'
            ELSE 'ok' END AS status
FROM s LEFT JOIN f USING (doc_id)""")
def r14(spark, sf):
    s, f = _features(spark, sf)
    return R.validate_features(s, f)


@register("R16_missing_feature_policy", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'load' ELSE 'generate' END AS action
FROM documents""")
def r16(spark, sf):
    return R.missing_feature_policy(_docs(spark, sf).select("doc_id"), table(spark, sf, "labels"), "generate", "doc_id")


@register("R16_missing_feature_skip", """
SELECT doc_id, 'load' AS action FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def r16s(spark, sf):
    return R.missing_feature_policy(_docs(spark, sf).select("doc_id"), table(spark, sf, "labels"), "skip", "doc_id")


@register("R17_failure_runs", """
WITH o AS (
  SELECT user_id, event_type = 'error' AS failed,
         sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
  FROM events),
runs AS (SELECT user_id, isl, count(*) AS len FROM o WHERE failed GROUP BY user_id, isl),
per AS (SELECT user_id, max(len) AS m FROM runs GROUP BY user_id)
SELECT u.user_id, coalesce(per.m, 0)::BIGINT AS max_fail_run, coalesce(per.m, 0) >= 3 AS abort
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN per USING (user_id)""")
def r17(spark, sf):
    ev = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    # buckets default to hours of ts: a user with a huge share of events is split
    return R.failure_runs(ev, ["user_id"], ["ts", "event_id"], "failed", 3)


@register("R19_response_integrity", f"""
WITH {_FEAT_SQL}
SELECT s.doc_id AS sample_idx,
       CASE WHEN f.token_ids IS NULL THEN 'missing prompt ids'
            WHEN s.input_ids IS DISTINCT FROM f.token_ids THEN 'prompt ids differ'
            WHEN s.doc_id % 7 = 0 THEN 'missing transfer record' END AS integrity_error
FROM s LEFT JOIN f USING (doc_id)""")
def r19(spark, sf):
    s, f = _features(spark, sf)
    j = s.join(f.select("sample_idx", F.col("token_ids").alias("response_prompt_ids")), "sample_idx", "left")
    j = j.withColumn("transfer", F.when(F.col("sample_idx") % 7 != 0, F.concat(F.lit("/feat/hs_"), F.col("sample_idx").cast("string"))))
    return R.response_integrity(j.withColumnRenamed("input_ids", "prompt_token_ids"),
                                "prompt_token_ids", "response_prompt_ids", "transfer").select("sample_idx", "integrity_error")


# ------------------------------------------------------------------ S group
@register("S10_feature_ids", r"""
WITH names AS (
  SELECT '/feat/hs_' || doc_id::VARCHAR || '.safetensors' AS name FROM documents
  UNION ALL SELECT '/feat/hs_' || lang || '.safetensors' FROM documents
  UNION ALL SELECT '/feat/data_' || doc_id::VARCHAR || '.pt' FROM documents)
SELECT DISTINCT CAST(regexp_extract(regexp_extract(name, '([^/]+)$', 1), '^hs_(.+)\.safetensors$', 1) AS BIGINT) AS idx
FROM names WHERE regexp_matches(regexp_extract(regexp_extract(name, '([^/]+)$', 1), '^hs_(.+)\.safetensors$', 1), '^[+-]?[0-9]+$')""")
def s10(spark, sf):
    d = _docs(spark, sf)
    names = (d.select(F.concat(F.lit("/feat/hs_"), F.col("doc_id").cast("string"), F.lit(".safetensors")).alias("name"))
             .unionByName(d.select(F.concat(F.lit("/feat/hs_"), F.col("lang"), F.lit(".safetensors")).alias("name")))
             .unionByName(d.select(F.concat(F.lit("/feat/data_"), F.col("doc_id").cast("string"), F.lit(".pt")).alias("name"))))
    return S.feature_ids(names)


@register("S12_sample_lengths", f"""
WITH f AS (SELECT doc_id AS file_id, n_chars AS size, len(regexp_extract_all(text, {TOKEN_RE})) AS ntok FROM documents),
first AS (SELECT size AS s0, ntok AS l0 FROM f ORDER BY file_id LIMIT 1),
side AS (SELECT f.file_id, f.ntok AS length FROM f JOIN labels l ON l.doc_id = f.file_id)
SELECT f.file_id, coalesce(side.length, ceil(f.size / first.s0 * first.l0))::BIGINT AS length,
       side.length IS NOT NULL AS exact
FROM f CROSS JOIN first LEFT JOIN side USING (file_id)""")
def s12(spark, sf):
    d = _docs(spark, sf)
    files = d.select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("size"),
                     F.size(tokenize("text")).alias("len0_hint"))
    side = files.join(table(spark, sf, "labels").select(F.col("doc_id").alias("file_id")), "file_id").select(
        "file_id", F.col("len0_hint").alias("length"))
    return S.sample_lengths(files, side)


@register("S19_max_tokens_document", """
WITH m AS (SELECT event_type, median(floor(value)) AS med FROM events GROUP BY event_type)
SELECT '{' || string_agg('"' || event_type || '":' || (pow(2, ceil(log2(greatest(med, 1)))))::BIGINT::VARCHAR, ','
                         ORDER BY event_type) || '}' AS max_tokens_json FROM m""")
def s19(spark, sf):
    ev = table(spark, sf, "events")
    m = ev.groupBy(F.col("event_type").alias("subset")).agg(F.median(F.floor("value")).alias("med"))
    m = m.select("subset", max_tokens_for(F.col("med")).alias("max_tokens"))
    return SK.max_tokens_document(m)


@register("S20_flatten_metrics", """
SELECT event_id, event_type AS "train/kind", value AS "train/metrics/value",
       CAST(json_extract(props, '$.k') AS BIGINT) AS "train/metrics/k"
FROM events""")
def s20(spark, sf):
    ev = table(spark, sf, "events")
    props = F.from_json("props", "k bigint")
    nested = ev.select("event_id", F.struct(F.col("event_type").alias("kind"), F.struct(
        F.col("value").alias("value"), props["k"].alias("k")).alias("metrics")).alias("train"))
    return S.flatten_columns(nested)


@register("S1_json_roundtrip", """
SELECT conv_id::VARCHAR AS id, count(*)::BIGINT AS n_turns, sum(length(text))::BIGINT AS n_chars
FROM conversations GROUP BY conv_id""")
def s1(spark, sf):
    """Writes the corpus as chat JSON lines (``from``/``value`` keys) into the
    checkpoint folder, reads it back with the fixed schema, normalises."""
    import uuid
    from draftkit.session import checkpoint_dir
    c = table(spark, sf, "conversations")
    nested = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt")
        .otherwise(F.col("role")).alias("from"), F.col("text").alias("value")))).alias("_t"))
    out = nested.select(F.col("conv_id").cast("string").alias("id"),
                        F.transform("_t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/json-{uuid.uuid4().hex}/part.jsonl"
    out.write.mode("overwrite").json(path)
    back = S.read_conversations(spark, path)
    n = N.normalize_turns(N.rename_messages(back.drop("messages")), "conversations")
    return n.select("id", F.size("conversations").cast("bigint").alias("n_turns"),
                    F.aggregate("conversations", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["content"])).alias("n_chars"))
