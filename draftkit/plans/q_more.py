"""Queries for the remaining normalisation, regex-mask, source/sink and
bulk-call operators."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from draftkit import schemas
from draftkit.functions.text import tokenize
from draftkit.operators import evals as E
from draftkit.operators import normalize as N
from draftkit.operators import sample as R
from draftkit.operators import tokens as TK
from draftkit.operators import vocab as V
from draftkit.plans import derived as D
from draftkit.plans import prepare as P
from draftkit.plans.catalog import round6, register, table
from draftkit.plans.sqlgen import TOKEN_RE, role_case, scrape_cte, sweep_points_cte, turn_tokens_ctes
from draftkit.session import materialize
from draftkit.sources import readers as S
from draftkit.sources import sinks as SK
from draftkit.sources.commits import committed
from draftkit.streaming.streams import scratch


def _none_turn_fields(**given):
    return F.struct(*[(given[f.name] if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name)
                      for f in schemas.RAW_TURN.fields])


# ------------------------------------------------------------------ N group
@register("N8_qa_pairs", """
SELECT item_id, 0::BIGINT AS turn, 'user' AS role, length(text)::BIGINT AS n_chars FROM benchmark
UNION ALL SELECT item_id, 1, 'assistant', length('Answer: ' || text) FROM benchmark""")
def n8(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"),
                                             F.concat(F.lit("Answer: "), F.col("text")).alias("answer"))
    t = N.qa_to_turns(b)
    return t.select("item_id", F.posexplode("turns").alias("turn", "t")).select(
        "item_id", F.col("turn").cast("bigint"), F.col("t.role").alias("role"),
        F.length("t.content").cast("bigint").alias("n_chars"))


@register("N9_prefix_filter", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')")
def n9(spark, sf):
    return N.prefix_filter(table(spark, sf, "pages").select("page_id", "url"), "url", "https://")


def _caption_rows(spark, sf):
    c = table(spark, sf, "conversations")
    value = F.when((F.col("role") == "user") & (F.col("turn") == 0), F.concat(F.lit("<image>\n"), F.col("text"))).otherwise(F.col("text"))
    raw = c.select("conv_id", "turn", _none_turn_fields(
        **{"from": F.when(F.col("role") == "user", F.lit("human")).otherwise(F.lit("gpt")), "value": value}).alias("t"))
    nested = raw.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("_s"))
    return nested.select("conv_id", F.transform("_s", lambda x: x["t"]).alias("turns"),
                         F.concat(F.lit("coco/"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image"))


@register("N10_N11_image_caption_parts", """
WITH t AS (
  SELECT conv_id, turn, role,
         CASE WHEN role = 'user' AND turn = 0 THEN '<image>' || chr(10) || text ELSE text END AS v FROM conversations),
p AS (
  SELECT conv_id, turn, role, unnest(CASE WHEN role = 'user' THEN string_split(v, chr(10)) ELSE [v] END) AS line,
         unnest(generate_series(0, len(CASE WHEN role = 'user' THEN string_split(v, chr(10)) ELSE [v] END) - 1)) AS part_idx
  FROM t)
SELECT conv_id, turn::BIGINT AS turn, part_idx::BIGINT AS part_idx,
       CASE WHEN role = 'user' AND line = '<image>' THEN 'image' ELSE 'text' END AS type,
       CASE WHEN role = 'user' AND line = '<image>' THEN -1 ELSE length(line) END::BIGINT AS text_len,
       CASE WHEN role = 'user' AND line = '<image>' THEN '/data/coco/' || conv_id::VARCHAR || '.jpg' END AS path
FROM p""")
def n10(spark, sf):
    d = _caption_rows(spark, sf)
    d = N.image_caption_parts(d, "turns", N.rewrite_path(F.col("image"), "coco/", "/data/coco"))
    ex = d.select("conv_id", F.posexplode("turns").alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("bigint"), F.posexplode("t.parts").alias("part_idx", "p"))
    return ex.select("conv_id", "turn", F.col("part_idx").cast("bigint"), F.col("p.type").alias("type"),
                     F.coalesce(F.length("p.text"), F.lit(-1)).cast("bigint").alias("text_len"), F.col("p.path").alias("path"))


_MEDIA_SQL = """
WITH p AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '#') THEN 'b64' WHEN starts_with(url, 'http://') THEN 'url' ELSE 'path' END AS kind FROM pages)
SELECT page_id, 'image_url' AS type,
       CASE kind WHEN 'url' THEN url WHEN 'path' THEN 'file:///img/' || page_id::VARCHAR || '.png' END AS url,
       CASE kind WHEN 'b64' THEN 'image base64 not supported' END AS reject
FROM p"""


@register("N12_N13_media_parts", _MEDIA_SQL)
def n13(spark, sf):
    pg = table(spark, sf, "pages")
    part = F.struct(*[(
        F.lit("image") if f.name == "type"
        else F.when(~F.col("url").contains("#") & F.col("url").startswith("http://"), F.col("url")) if f.name == "url"
        else F.when(~F.col("url").contains("#") & ~F.col("url").startswith("http://"),
                    F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png"))) if f.name == "path"
        else F.when(F.col("url").contains("#"), F.lit("QUJD")) if f.name == "base64"
        else F.lit(None).cast("string")).alias(f.name) for f in schemas.PART.fields])
    r = pg.select("page_id", N.media_part_to_url(part).alias("r"))
    return r.select("page_id", "r.type", "r.url", "r.reject")


@register("N14_N15_request_payload", f"""
SELECT conv_id, bool_or({role_case('role')} = 'user' AND contains(text, '?')) AS has_mm,
       CASE WHEN bool_or({role_case('role')} = 'user' AND contains(text, '?')) THEN count(*) ELSE 0 END::BIGINT AS n_messages
FROM conversations GROUP BY conv_id""")
def n14(spark, sf):
    c = table(spark, sf, "conversations")
    parts = F.when((F.col("role") == "user") & F.col("text").contains("?"), F.array(F.struct(*[
        (F.lit("text") if f.name == "type" else F.col("text") if f.name == "text" else F.lit(None).cast("string")).alias(f.name)
        for f in schemas.PART.fields])))
    raw = c.select("conv_id", "turn", _none_turn_fields(role=F.col("role"), content=F.col("text"), parts=parts).alias("t"))
    nested = raw.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("_s"))
    nested = nested.select("conv_id", F.transform("_s", lambda x: x["t"]).alias("turns"),
                           F.array().cast("array<int>").alias("input_ids"))
    n = N.normalize_turns(nested)
    p = N.request_payload(n)
    # messages travel only for multimodal samples; 0 when none are sent
    return p.select("conv_id", N.has_multimodal(F.col("turns")).alias("has_mm"),
                    F.coalesce(F.size("payload.messages"), F.lit(-1)).cast("bigint").alias("n_messages")).withColumn(
        "n_messages", F.when(F.col("has_mm"), F.col("n_messages")).otherwise(F.lit(0)))


_TYPED_SQL = f"""
WITH t AS (
  SELECT conv_id, {role_case('role')} AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn
  FROM conversations WHERE {role_case('role')} IS NOT NULL)
SELECT conv_id::VARCHAR AS id, turn::BIGINT AS turn, role,
       CASE turn % 4 WHEN 0 THEN '[1] ' || text WHEN 1 THEN '[INST] ' || text WHEN 3 THEN text END AS content,
       CASE WHEN turn % 4 = 2 THEN 'text:' || text || '|image:img/' || conv_id::VARCHAR || '.png' END AS parts,
       CASE WHEN turn % 4 = 3 THEN 'because' END AS thinking,
       CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'lookup' END AS tool FROM t"""


@register("N2_N3_N4_N7_N12_typed_json", _TYPED_SQL)
def n2(spark, sf):
    """A chat file whose texts start like lists (``[1] ...``, ``[INST] ...``)
    beside real part lists, tool calls and reasoning, half of it under
    ``messages``: written as JSON lines, read, renamed and normalised."""
    c = N.normalize_rows(table(spark, sf, "conversations"))
    c = c.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    def quoted(x):  # a JSON string
        return F.expr(f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    body = (F.when(F.col("n") % 4 == 0, quoted("concat('[1] ', text)")).when(F.col("n") % 4 == 1, quoted("concat('[INST] ', text)"))
            .when(F.col("n") % 4 == 2, F.concat(F.lit("["), quoted("text"), F.lit(', {"type": "image", "path": "img/'), F.col("conv_id").cast("string"), F.lit('.png"}]')))
            .otherwise(quoted("text")))
    more = (F.when(F.col("n") % 4 == 3, F.lit(', "reasoning_content": "because"'))
            .when((F.col("role") == "assistant") & (F.col("n") % 4 == 1),
                  F.lit(', "tool_calls": [{"id": "c", "type": "function", "function": {"name": "lookup", "arguments": "{}"}}]')).otherwise(F.lit("")))
    turn = F.concat(F.lit('{"role": '), quoted("role"), F.lit(', "content": '), body, more, F.lit("}"))
    rows = c.select("conv_id", "n", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("s"))
    key = F.when(F.col("conv_id") % 2 == 0, F.lit("conversations")).otherwise(F.lit("messages"))
    lines = rows.select(F.concat(F.lit('{"id": "'), F.col("conv_id").cast("string"), F.lit('", "'), key, F.lit('": ['),
                                 F.array_join(F.transform("s", lambda x: x["t"]), ", "), F.lit("]}")).alias("value"))
    path = scratch(spark, "typed-chat") + ".jsonl"
    lines.write.text(path)
    n = N.normalize_turns(N.rename_messages(S.read_conversations(spark, path)), "conversations")
    flat = N.unfold_turns(n.select("id", "conversations"), "conversations")
    return flat.select("id", "turn", "role", "content", F.array_join(F.transform("parts", lambda p: F.concat(
        p["type"], F.lit(":"), F.coalesce(p["text"], p["path"]))), "|").alias("parts"), "thinking", F.col("tool_calls")[0]["function"]["name"].alias("tool"))


@register("N17_quarantine", """
WITH e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT count(*) FILTER (WHERE k IS NOT NULL AND k <= 95)::BIGINT AS n_good,
       count(*) FILTER (WHERE k IS NULL OR k > 95)::BIGINT AS n_failed FROM e""")
def n17(spark, sf):
    ev = table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    err = F.when(F.col("k").isNull(), F.lit("unparsable props")).when(F.col("k") > 95, F.lit("k out of range"))
    good, bad = N.quarantine(ev.withColumn("error", err))
    u = good.select(F.lit(1).alias("_g")).unionByName(bad.select(F.lit(0).alias("_g")))
    return u.agg(F.count_if(F.col("_g") == 1).cast("bigint").alias("n_good"),
                 F.count_if(F.col("_g") == 0).cast("bigint").alias("n_failed"))


# ------------------------------------------------------------------ T group (regex path)
def _regex_masked(spark, sf):
    """Rendered conversations -> token offsets -> detected-pattern spans ->
    overlap mask (T2, T5, T6).  One row per conversation holds its whole
    rendered text (the pattern path needs it)."""
    t = TK.TEMPLATES["chatml"]
    rows = N.normalize_rows(table(spark, sf, "conversations"))
    pieces = TK.render_pieces(rows, t)
    texts = pieces.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("text"))
    texts = texts.withColumn("offsets", TK.token_offsets(F.col("text")))
    pattern = TK.choose_mask_source(None, TK.ChatTemplate("chatml-probe", t.bos, t.prefix, t.suffix, provides_mask=False))[1]
    m = TK.with_assistant_mask(texts, "text", "offsets", pattern, key_cols=["conv_id"])
    return m.select("conv_id", F.size("offsets").cast("bigint").alias("seq_len"),
                    F.size(F.filter("loss_mask", lambda x: x)).cast("bigint").alias("n_trainable"),
                    F.col("n_spans").cast("bigint").alias("n_spans"))


_TOK_ALL = turn_tokens_ctes("chatml", 1 << 30)


@register("T2_T5_T6_regex_mask", f"""
WITH {_TOK_ALL}
SELECT t.conv_id, count(*)::BIGINT AS seq_len, count(*) FILTER (WHERE trainable)::BIGINT AS n_trainable,
       (SELECT count(*) FROM norm n WHERE n.conv_id = t.conv_id AND n.role = 'assistant')::BIGINT AS n_spans
FROM toks t GROUP BY t.conv_id""")
def t256(spark, sf):
    return _regex_masked(spark, sf)


@register("T10_span_counters", f"""
WITH {_TOK_ALL},
s AS (SELECT conv_id, count(*) AS seq_len,
             (SELECT count(*) FROM norm n WHERE n.conv_id = t.conv_id AND n.role = 'assistant') AS n_spans
      FROM toks t GROUP BY conv_id)
SELECT count(*) FILTER (WHERE n_spans = 0)::BIGINT AS no_span,
       count(*) FILTER (WHERE n_spans = 0 AND seq_len = 8192)::BIGINT AS no_span_at_max FROM s""")
def t10(spark, sf):
    return TK.span_counters(_regex_masked(spark, sf), 8192)


@register("T11_mask_runs", f"""
WITH {turn_tokens_ctes('llama3', 8192)},
c AS (SELECT *, CASE WHEN lag(trainable) OVER (PARTITION BY conv_id ORDER BY pos) IS NOT DISTINCT FROM trainable THEN 0 ELSE 1 END AS chg FROM toks),
r AS (SELECT *, sum(chg) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run FROM c)
SELECT conv_id, run::BIGINT AS run, any_value(trainable) AS trainable, min(pos)::BIGINT AS start, count(*)::BIGINT AS n_tokens,
       string_agg(token, ' ' ORDER BY pos) AS text
FROM r GROUP BY conv_id, run""")
def t11(spark, sf):
    return TK.mask_runs(P.corpus_tokens(table(spark, sf, "conversations"), "llama3", 8192))


# ------------------------------------------------------------------ S group (file round trips)
@register("S2_S3_dataset_registry", """
SELECT doc_id, md5(text) AS prompt_md5 FROM documents WHERE lang = 'de'""")
def s2(spark, sf):
    src = S.PromptSource("documents", prompt_field="text")
    registry = {"documents_de": S.DatasetConfig("documents_de", f"{sf.rstrip('/')}/documents.parquet",
                                                filter=F.col("lang") == "de",
                                                normalize=lambda df: S.prompts_of(df, src))}
    d = S.load_dataset(spark, registry, "documents_de")
    return d.select("doc_id", F.md5("prompt").alias("prompt_md5"))


@register("S4_S5_prepared_roundtrip", f"""
WITH {turn_tokens_ctes('chatml', 8192)}
SELECT conv_id AS sample_idx, count(*)::BIGINT AS seq_len, count(*) FILTER (WHERE trainable)::BIGINT AS n_trainable
FROM toks GROUP BY conv_id""")
def s4(spark, sf):
    s = P.prepared_samples(table(spark, sf, "conversations"), "chatml", 8192)
    out = scratch(spark, "prepared")
    SK.write_prepared(s.select(F.col("conv_id").alias("sample_idx"), F.col("input_ids").cast("array<int>"),
                               "loss_mask", F.col("seq_len").cast("int")), out)
    assert not SK.write_prepared(s, out)  # finished output is kept
    back = S.read_prepared(spark, out)
    return back.select("sample_idx", "seq_len", F.size(F.filter("loss_mask", lambda x: x)).cast("bigint").alias("n_trainable"))


_VOCAB_SQL_BASE = f"""
WITH {turn_tokens_ctes('chatml', 8192)},
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM toks GROUP BY token)),
freq AS (SELECT v.token_id, count(*) AS freq FROM toks JOIN vocab v USING (token) WHERE trainable GROUP BY v.token_id)"""


@register("S8_S9_vocab_sinks", _VOCAB_SQL_BASE + """,
sel AS (SELECT token_id FROM freq ORDER BY freq DESC, token_id LIMIT 512)
SELECT (row_number() OVER (ORDER BY token_id) - 1)::BIGINT AS draft_id, token_id::BIGINT AS target_id,
       (token_id - (row_number() OVER (ORDER BY token_id) - 1))::BIGINT AS "offset",
       (SELECT count(*) FROM freq)::BIGINT AS n_freq_rows
FROM sel""")
def s8(spark, sf):
    toks = P.corpus_tokens(table(spark, sf, "conversations"), "chatml", 8192)
    vocab = TK.build_vocabulary(toks, extra_aggs=[F.count_if("trainable").alias("freq")])
    freq = vocab.filter(F.col("freq") > 0).select("token_id", "freq")
    fpath, mpath = scratch(spark, "freq"), scratch(spark, "maps")
    SK.write_token_frequency(freq, fpath)
    assert not SK.write_token_frequency(freq, fpath)  # no-op when present
    f = spark.read.parquet(fpath)
    d2t, t2d = V.build_maps(f, 512, 131072)
    SK.write_vocab_maps(d2t, t2d, mpath)
    d2t_b, _t2d_b = SK.read_vocab_maps(spark, mpath)
    return d2t_b.withColumn("n_freq_rows", F.lit(f.count()).cast("bigint"))


_PTS_SQL = f"""
WITH {sweep_points_cte()}
SELECT label, regexp_replace(subset, '^run_', '') AS subset, x, (floor((y) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS y FROM sweep WHERE strategy = 'constant'"""


@register("S14_S15_S16_S18_sweep_csv", _PTS_SQL)
def s14(spark, sf):
    pts = D.sweep_points(spark, sf)
    specs = []
    for label in ("0", "1"):
        path = scratch(spark, f"sweep-{label}") + ".csv"
        rows = pts.filter(F.col("label") == label).drop("label")
        for _ in range(2):  # the second time adds nothing
            SK.append_csv(rows.withColumn("extra_key", F.lit("ignored")), path,
                          columns=["subset", "strategy", "rps_median", "latency_median_s"], run_id="sweep")
        specs.append(f"{label}={committed(spark, path)['sweep']}")
    got = S.read_labelled(spark, specs)
    p = E.chart_points(got, "latency", "rps_median")
    return p.select("label", "subset", "x", round6(F.col("y")).alias("y"))


@register("S17_counter_text", f"""
WITH {scrape_cte('sc')}
SELECT subset, name, coalesce(position, -1)::BIGINT AS position, value FROM sc""")
def s17(spark, sf):
    lines = D.counter_lines(spark, sf)
    base = scratch(spark, "metrics")
    lines.write.partitionBy("subset").text(base)
    missing = S.read_counter_text(spark, base + "/no-such-file.txt")
    assert missing.count() == 0
    back = S.read_counter_text(spark, base).unionByName(missing.withColumn("subset", F.lit("x")), allowMissingColumns=True)
    t = E.scrape_totals(E.parse_counter_lines(back, ["subset"]), ["subset"])
    return t.select("subset", "name", F.coalesce("position", F.lit(-1)).alias("position"), "value")


# ------------------------------------------------------------------ U6 / R18
@register("U6_R18_bulk_call", """
SELECT doc_id, length(text)::BIGINT AS out, 1::BIGINT AS attempts, NULL::VARCHAR AS error FROM documents""")
def u6(spark, sf):
    """The batch form of the call; the called function gets whole batches of
    texts."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    r = R.bulk_call_batches(d, _lengths, "out", "bigint", inputs=["text"])
    return r.select("doc_id", "out", F.col("attempts").cast("bigint"), "error")


def _lengths(rows):
    return [(None if r["text"] is None else len(r["text"]), 1, None) for r in rows]


class _Unsteady:
    """The length of a row's text, after ``doc_id % 6`` failed calls; of the
    rest 4 no call succeeds, and 5 gets an invalid response."""

    def __init__(self):
        self.row, self.calls = None, 0

    def __call__(self, row):
        if row is not self.row:  # calls for a row follow each other
            self.row, self.calls = row, 0
        self.calls += 1
        rest = -1 if row["doc_id"] is None else row["doc_id"] % 6
        if rest == 5:
            raise R.InvalidResponse("no ids")
        if rest == 4 or self.calls <= rest:
            raise ConnectionError("busy")
        return None if row["text"] is None else len(row["text"])


@register("R18_bulk_call_retries", """
SELECT doc_id, coalesce(CASE WHEN doc_id % 6 < 4 THEN length(text) END, -1)::BIGINT AS out,
       CASE doc_id % 6 WHEN 5 THEN 1 WHEN 4 THEN 4 ELSE doc_id % 6 + 1 END::BIGINT AS attempts,
       CASE doc_id % 6 WHEN 5 THEN 'invalid response: no ids' WHEN 4 THEN 'ConnectionError: busy' END AS error FROM documents""")
def r18(spark, sf):
    """One call per row with retries (without waits); -1 is no result."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    r = R.bulk_call(d, _Unsteady(), "out", "bigint", base_delay=0)
    return r.select("doc_id", F.coalesce("out", F.lit(-1)).alias("out"), F.col("attempts").cast("bigint"), "error")


IN_FLIGHT, STOP_AFTER = 8, 4


class _Together:
    """The length of a row's text, beside the most calls that were in flight
    at once in this task.  The first calls wait for each other, so that the
    figure is what the window allows, not what time happens to show."""

    def __init__(self, want: int):
        self.want, self.lock, self.now, self.peak = want, None, 0, 0

    def __call__(self, row):
        with self.lock:
            self.now += 1
            self.peak = max(self.peak, self.now)
        for _ in range(100):
            if self.peak >= self.want:
                break
            time.sleep(0.002)
        with self.lock:
            self.now -= 1
        return None if row["text"] is None else {"n": len(row["text"]), "peak": self.peak}

    def start(self):
        self.lock = threading.Lock()


@register("U6_bounded_concurrency", f"""
SELECT lang, count(*)::BIGINT AS n_rows, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, {IN_FLIGHT}::BIGINT AS most_in_flight
FROM documents GROUP BY lang""")
def u6c(spark, sf):
    """At most IN_FLIGHT calls of a task at once; the caller tells its peak."""
    d = table(spark, sf, "documents").select("lang", "text")
    r = R.bulk_call_window(d, _Together(IN_FLIGHT), "out", "struct<n:bigint,peak:bigint>", concurrency=IN_FLIGHT, retries=0)
    r = r.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("out.n"), F.lit(0)).alias("n_chars"), F.max("out.peak").alias("_peak"))
    r = materialize(r, "calls")
    most = r.agg(F.max("_peak").alias("most_in_flight"))  # one row beside one a language
    return r.drop("_peak").crossJoin(F.broadcast(most))


class _Down:
    """The length of a row's text; three rows of five can't be reached."""

    def __call__(self, row):
        if row["doc_id"] * 7 % 11 % 5 < 3:
            raise ConnectionError("unreachable")
        return None if row["text"] is None else len(row["text"])


@register("R17_abort_calls", f"""
WITH d AS (SELECT doc_id, text, doc_id // 500 AS block, doc_id * 7 % 11 % 5 < 3 AS bad, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS rn FROM documents),
i AS (SELECT *, sum((NOT bad)::INTEGER) OVER (PARTITION BY block ORDER BY rn) AS isl FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY block, isl ORDER BY rn) - (CASE WHEN isl > 0 THEN 1 ELSE 0 END) AS run FROM i),
stop AS (SELECT block, min(rn) AS last_straw FROM f WHERE bad AND run >= {STOP_AFTER} GROUP BY block)
SELECT doc_id, block, coalesce(rn < last_straw + {IN_FLIGHT}, true) AS attempted, last_straw IS NOT NULL AS aborted,
  coalesce(CASE WHEN NOT bad AND coalesce(rn < last_straw + {IN_FLIGHT}, true) THEN length(text) END, -1)::BIGINT AS out,
  CASE WHEN NOT coalesce(rn < last_straw + {IN_FLIGHT}, true) THEN 'not attempted' WHEN bad THEN 'ConnectionError: unreachable' END AS error
FROM f LEFT JOIN stop USING (block)""")
def r17a(spark, sf):
    """Blocks of 500 ids stand for endpoints: after STOP_AFTER failures in a
    row (in id order) no further call is made in the block; what was in
    flight then is still taken."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 500).cast("bigint").alias("block"))
    d = d.repartition("block").sortWithinPartitions("block", "doc_id")
    r = R.bulk_call_window(d, _Down(), "out", "bigint", concurrency=IN_FLIGHT, retries=0, stop_after=STOP_AFTER, scope=["block"])
    r = materialize(r.drop("text"), "calls")
    aborted = r.groupBy("block").agg(F.bool_or(~F.col("attempted") | F.col("stopped")).alias("aborted"))
    return r.join(aborted, "block").select("doc_id", "block", "attempted", "aborted", F.coalesce("out", F.lit(-1)).alias("out"), "error")


# ------------------------------------------------------------------ E21 on tokens
@register("T13_E21_token_totals", f"""
SELECT role, sum(len(regexp_extract_all(coalesce(text, ''), {TOKEN_RE})))::BIGINT AS n_tokens
FROM conversations GROUP BY role""")
def t13e21(spark, sf):
    c = table(spark, sf, "conversations").withColumn("tokens", tokenize("text"))
    return E.total_output_tokens(c, "tokens", ["role"]).withColumnRenamed("total_num_output_tokens", "n_tokens")
