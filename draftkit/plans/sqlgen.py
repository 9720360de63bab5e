"""DuckDB SQL fragments for the oracle, generated from the same fixed values
(role aliases, templates, tokenizer pattern) the Spark operators use."""

from __future__ import annotations

from draftkit.functions.text import TOKEN_PATTERN, tokenize_local
from draftkit.operators.normalize import ROLE_ALIASES
from draftkit.operators.tokens import BOS_ORD, TEMPLATES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def role_case(col: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in ROLE_ALIASES.items())
    return f"CASE coalesce({col}, '') {whens} END"


def str_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]::VARCHAR[]"


def tokens_case(col: str, values: dict) -> str:
    whens = " ".join(f"WHEN {q(r)} THEN {str_list(tokenize_local(v))}" for r, v in values.items())
    return f"CASE {col} {whens} ELSE []::VARCHAR[] END"


def str_case(col: str, values: dict) -> str:
    whens = " ".join(f"WHEN {q(r)} THEN {q(v)}" for r, v in values.items())
    return f"CASE {col} {whens} ELSE '' END"


TOKEN_RE = q(TOKEN_PATTERN)


def turn_tokens_ctes(template: str = "chatml", max_length: int = 2048, source: str = "conversations") -> str:
    """CTEs ``norm``, ``tt``, ``st`` (turn rows with start, tokens, np/nb/ns)
    and ``toks`` (conv_id, pos, token, trainable) for a template."""
    t = TEMPLATES[template]
    bos = ""
    if t.bos:
        bos = (f"UNION ALL SELECT DISTINCT conv_id, {BOS_ORD}::BIGINT AS ord, 'bos' AS role, "
               f"{str_list(tokenize_local(t.bos))} AS p, []::VARCHAR[] AS b, []::VARCHAR[] AS s FROM norm")
    return f"""
norm AS (
  SELECT conv_id, turn, {role_case('role')} AS role, coalesce(text, '') AS text
  FROM {source}),
tt AS (
  SELECT conv_id, turn::BIGINT AS ord, role,
         {tokens_case('role', t.prefix)} AS p,
         regexp_extract_all(text, {TOKEN_RE}) AS b,
         {tokens_case('role', t.suffix)} AS s
  FROM norm WHERE role IS NOT NULL
  {bos}),
tk AS (
  SELECT conv_id, ord, role, list_concat(list_concat(p, b), s) AS tokens,
         len(p) AS np, len(b) AS nb, len(s) AS ns FROM tt),
st AS (
  SELECT *, coalesce(sum(np + nb + ns) OVER (PARTITION BY conv_id ORDER BY ord
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM tk),
ex AS (
  SELECT conv_id, ord, role, start, np, nb, tokens, unnest(generate_series(1, len(tokens))) AS i FROM st),
toks AS (
  SELECT conv_id, ord, (start + i - 1)::BIGINT AS pos, tokens[i] AS token,
         (role = 'assistant' AND i > np AND i <= np + nb) AS trainable
  FROM ex WHERE start + i - 1 < {max_length})"""


# ---------------------------------------------------------------- derived
def hx(expr: str, n: int = 8) -> str:
    """First ``n`` hex digits of ``md5(expr)`` as an integer."""
    return f"CAST(('0x' || substr(md5({expr}), 1, {n})) AS BIGINT)"


def sample_tokens_ctes(max_length: int = 256, vocab: int = 50000) -> str:
    """CTEs ending in ``stok(sample_idx, pos, token, mask)`` and
    ``samples(sample_idx, input_ids, loss_mask, seq_len)``."""
    return turn_tokens_ctes("chatml", max_length) + f""",
stok AS (SELECT conv_id AS sample_idx, pos, {hx('token', 6)} % {vocab} AS token, trainable AS mask FROM toks),
samples AS (
  SELECT sample_idx, list(token ORDER BY pos) AS input_ids, list(mask ORDER BY pos) AS loss_mask,
         count(*)::BIGINT AS seq_len FROM stok GROUP BY sample_idx)"""


def scrape_cte(name: str, where: str = "TRUE") -> str:
    """``name(subset, name, position, value)`` from events."""
    return f"""
{name}_g AS (
  SELECT event_type AS subset, count(*)::DOUBLE AS d,
         sum(floor(value)::BIGINT % 4)::DOUBLE AS acc,
         count(*) FILTER (WHERE floor(value)::BIGINT % 4 > 0)::DOUBLE AS p0,
         count(*) FILTER (WHERE floor(value)::BIGINT % 4 > 1)::DOUBLE AS p1,
         count(*) FILTER (WHERE floor(value)::BIGINT % 4 > 2)::DOUBLE AS p2
  FROM events WHERE {where} GROUP BY event_type),
{name} AS (
  SELECT subset, 'vllm:spec_decode_num_drafts' AS name, NULL::INTEGER AS position, d AS value FROM {name}_g
  UNION ALL SELECT subset, 'vllm:spec_decode_num_draft_tokens', NULL, 3 * d FROM {name}_g
  UNION ALL SELECT subset, 'vllm:spec_decode_num_accepted_tokens', NULL, acc FROM {name}_g
  UNION ALL SELECT subset, 'vllm:spec_decode_num_accepted_tokens_per_pos', 0, p0 FROM {name}_g
  UNION ALL SELECT subset, 'vllm:spec_decode_num_accepted_tokens_per_pos', 1, p1 FROM {name}_g
  UNION ALL SELECT subset, 'vllm:spec_decode_num_accepted_tokens_per_pos', 2, p2 FROM {name}_g)"""


def predictions_ctes(seed: int = 42, steps: int = 3) -> str:
    """After ``sample_tokens_ctes``: ``preds(sample_idx, pos, step, target,
    mask, draw, pred, loss)``, the loss being the KL divergence of the draw's
    logits."""
    draw = hx(f"concat_ws(':', '{seed}', b.sample_idx::VARCHAR, b.pos::VARCHAR, b.step::VARCHAR)")
    logits = lambda first: "[" + ", ".join(f"((draw >> {8 * i + first}) & 15) / 4.0" for i in range(4)) + "]"
    return f""",
pbase AS (SELECT sample_idx, pos, unnest(generate_series(0, {steps - 1})) AS step FROM stok),
pdraw AS (
  SELECT b.sample_idx, b.pos, b.step::INTEGER AS step, t.token AS target, t.mask, {draw} AS draw
  FROM pbase b JOIN stok t ON t.sample_idx = b.sample_idx AND t.pos = b.pos + b.step),
plog AS (SELECT *, {logits(0)}::DOUBLE[] AS dl, {logits(4)}::DOUBLE[] AS tl FROM pdraw),
plse AS (SELECT *, {lse('dl')} AS ld, {lse('tl')} AS lt FROM plog),
preds AS (
  SELECT sample_idx, pos, step, target, mask, draw, CASE WHEN draw % 4 > 0 THEN target ELSE target + 1 END AS pred,
         list_sum(list_transform(generate_series(1, 4), lambda i: exp(tl[i] - lt) * ((tl[i] - lt) - (dl[i] - ld)))) AS loss
  FROM plse)"""


def logit_pairs_cte(lag: int = 1) -> str:
    return f"""
pairs AS (
  SELECT a.vec_id, a.label, list_transform(a.embedding, lambda x: x::DOUBLE) AS draft,
         list_transform(b.embedding, lambda x: x::DOUBLE) AS target
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + {lag})"""


def round6_sql(x: str) -> str:
    """The SQL twin of ``catalog.round6``."""
    return f"(floor(({x}) * 1000000.000001::DOUBLE + 0.5) / 1e6)"


LSE = "(list_max({a}) + ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a}))))))"


def lse(a: str) -> str:
    return LSE.format(a=a)


def argmax_sql(a: str) -> str:
    return f"(list_position({a}, list_max({a})) - 1)"


def metric_log_cte() -> str:
    return """
mlog_g AS (
  SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS epoch, hour(ts) AS batch, event_type,
         sum(value) AS s, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
mlog AS (
  SELECT epoch, batch, event_type || '_sum' AS name, s AS value FROM mlog_g
  UNION ALL SELECT epoch, batch, event_type || '_total', n FROM mlog_g
  UNION ALL SELECT datediff('day', DATE '2024-01-01', ts::DATE), hour(ts), 'lr', avg(value) FROM events GROUP BY 1, 2)"""


def sweep_points_cte() -> str:
    return """
sweep AS (
  SELECT (user_id % 2)::VARCHAR AS label, 'run_' || event_type AS subset,
         CASE WHEN hour(date_trunc('hour', ts)) = 0 THEN 'throughput' ELSE 'constant' END AS strategy,
         count(*)::DOUBLE AS x, median(value) AS y
  FROM events GROUP BY (user_id % 2), event_type, date_trunc('hour', ts))"""
