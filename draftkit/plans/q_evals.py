"""Queries for serving-evaluation analytics (E) and benchmark sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftkit.functions.text import tokenize
from draftkit.operators import evals as E
from draftkit.plans import derived as D
from draftkit.plans.catalog import round6, register, table
from draftkit.plans.sqlgen import TOKEN_RE, scrape_cte, sweep_points_cte

KEY = ["subset"]


def r6(c):
    return round6(c)


def _totals(spark, sf):
    parsed = E.parse_counter_lines(D.counter_lines(spark, sf), KEY)
    return E.scrape_totals(parsed, KEY, duplicates="max")


def _baseline_totals(spark, sf):
    return D.baseline_scrape(spark, sf)


@register("E1_parse_counter_lines", f"""
WITH {scrape_cte('sc')}
SELECT subset, name, coalesce(position, -1)::BIGINT AS position, value FROM sc
UNION ALL
SELECT subset, name, position::BIGINT, floor(value / 2) FROM sc WHERE position IS NOT NULL""")
def e1(spark, sf):
    p = E.parse_counter_lines(D.counter_lines(spark, sf), KEY)
    return p.select("subset", "name", F.coalesce("position", F.lit(-1)).alias("position"), "value")


@register("E2_scrape_totals", f"""
WITH {scrape_cte('sc')}
SELECT subset, name, coalesce(position, -1)::BIGINT AS position, value FROM sc""")
def e2(spark, sf):
    t = _totals(spark, sf)
    return t.select("subset", "name", F.coalesce("position", F.lit(-1)).alias("position"), "value")


_DELTA = f"""
WITH {scrape_cte('sa')}, {scrape_cte('sb0', "ts < TIMESTAMP '2024-01-15 00:00:00'")},
sb AS (SELECT * FROM sb0 WHERE NOT (subset = 'view' AND position IS NOT DISTINCT FROM 2)),
delta AS (
  SELECT coalesce(a.subset, b.subset) AS subset, coalesce(a.name, b.name) AS name,
         coalesce(a.position, b.position) AS position, coalesce(a.value, 0) - coalesce(b.value, 0) AS value
  FROM sa a FULL OUTER JOIN sb b ON a.subset = b.subset AND a.name = b.name
       AND a.position IS NOT DISTINCT FROM b.position),
scal AS (
  SELECT subset,
    sum(CASE WHEN name = 'vllm:spec_decode_num_drafts' THEN value ELSE 0 END) AS num_drafts,
    sum(CASE WHEN name = 'vllm:spec_decode_num_draft_tokens' THEN value ELSE 0 END) AS num_draft_tokens,
    sum(CASE WHEN name = 'vllm:spec_decode_num_accepted_tokens' THEN value ELSE 0 END) AS num_accepted_tokens
  FROM delta WHERE position IS NULL GROUP BY subset),
scal2 AS (SELECT *, CASE WHEN num_drafts > 0 THEN 1 + num_accepted_tokens / num_drafts ELSE 0 END AS acceptance_length FROM scal),
pos AS (
  SELECT d.subset, d.position, 'acceptance_at_pos_' || d.position::VARCHAR AS metric,
         CASE WHEN s.num_drafts > 0 THEN sum(d.value) / s.num_drafts ELSE 0 END AS rate
  FROM delta d JOIN scal2 s USING (subset) WHERE d.position IS NOT NULL GROUP BY d.subset, d.position, s.num_drafts)"""


def _delta(spark, sf):
    return E.subtract_baseline(_totals(spark, sf), _baseline_totals(spark, sf), KEY)


@register("E3_subtract_baseline", _DELTA + """
SELECT subset, name, coalesce(position, -1)::BIGINT AS position, (floor((value) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS value FROM delta""")
def e3(spark, sf):
    d = _delta(spark, sf)
    return d.select("subset", "name", F.coalesce("position", F.lit(-1)).alias("position"), r6(F.col("value")).alias("value"))


@register("E4_acceptance_rates", _DELTA + """
SELECT subset, (floor((num_drafts) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS num_drafts, (floor((num_draft_tokens) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS num_draft_tokens,
       (floor((num_accepted_tokens) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS num_accepted_tokens, (floor((acceptance_length) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS acceptance_length
FROM scal2""")
def e4(spark, sf):
    scal, _pos = E.acceptance_rates(_delta(spark, sf), KEY)
    return scal.select("subset", *[r6(F.col(c)).alias(c) for c in
                                   ("num_drafts", "num_draft_tokens", "num_accepted_tokens", "acceptance_length")])


@register("E5_acceptance_per_token", _DELTA + """
SELECT subset, position::BIGINT AS position, 'acceptance_at_token_' || position::VARCHAR AS metric, (floor((rate) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS rate FROM pos""")
def e5(spark, sf):
    _scal, pos = E.acceptance_rates(_delta(spark, sf), KEY, no_drafts_length=1.0, pos_prefix="acceptance_at_token_")
    return pos.select("subset", "position", "metric", r6(F.col("rate")).alias("rate"))


@register("E6_acceptance_wide", _DELTA + """
SELECT s.subset, (floor((s.acceptance_length) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS acceptance_length,
       (floor((max(CASE WHEN p.position = 0 THEN p.rate END)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS acceptance_at_pos_0,
       (floor((max(CASE WHEN p.position = 1 THEN p.rate END)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS acceptance_at_pos_1,
       (floor((max(CASE WHEN p.position = 2 THEN p.rate END)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS acceptance_at_pos_2
FROM scal2 s LEFT JOIN pos p USING (subset) GROUP BY s.subset, s.acceptance_length""")
def e6(spark, sf):
    scal, pos = E.acceptance_rates(_delta(spark, sf), KEY)
    w = E.acceptance_wide(scal, pos, KEY, 3)
    return w.select("subset", r6(F.col("acceptance_length")).alias("acceptance_length"),
                    *[r6(F.col(f"acceptance_at_pos_{i}")).alias(f"acceptance_at_pos_{i}") for i in range(3)])


@register("E7_E8_output_length_stats", """
SELECT event_type AS subset, count(*)::BIGINT AS count, (floor((median(floor(value))) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS median,
       min(floor(value))::BIGINT AS min, max(floor(value))::BIGINT AS max,
       pow(2, ceil(log2(greatest(median(floor(value)), 1))))::BIGINT AS max_tokens
FROM events GROUP BY event_type""")
def e7(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("subset"),
                                           F.floor("value").cast("bigint").alias("output_tokens"))
    s = E.output_length_stats(ev, KEY)
    return s.select("subset", "count", r6(F.col("median")).alias("median"), "min", "max", "max_tokens")


def _bench_docs(spark, sf):
    """Benchmark result entries (one document per subset) built from events:
    one entry per hour; the first hour is a throughput run."""
    ev = table(spark, sf, "events")
    g = ev.groupBy("event_type", F.date_trunc("hour", "ts").alias("hh")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.median("value").alias("med"),
        F.max("value").alias("mx"), F.min("value").alias("mn"), F.avg("value").alias("av"),
        F.sum(F.floor("value")).cast("double").alias("tok"))
    stat = lambda c: F.struct(F.struct(F.col(c).alias("mean"), F.col(c).alias("median"),
                                       F.lit(None).cast("double").alias("sum")).alias("successful"))
    entry = F.struct(
        F.struct(F.struct(F.when(F.hour("hh") == 0, F.lit("throughput")).otherwise(F.lit("constant")).alias("type_"),
                          F.hour("hh").cast("double").alias("rate")).alias("strategy")).alias("config"),
        F.struct(stat("n").alias("requests_per_second"), stat("med").alias("request_latency"),
                 stat("mx").alias("time_to_first_token_ms"), stat("mn").alias("inter_token_latency_ms"),
                 stat("av").alias("output_tokens_per_second"),
                 F.struct(F.struct(F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("median"),
                                   F.col("tok").alias("sum")).alias("successful")).alias("output_tokens")
                 ).alias("metrics"))
    docs = g.groupBy("event_type").agg(F.collect_list(entry).alias("benchmarks"))
    return docs.select(F.concat(F.lit("/results/sweeps_"), F.col("event_type"), F.lit(".json")).alias("file"),
                       F.inline("benchmarks"))


_SWEEP_SQL = """
sw AS (
  SELECT event_type AS subset, 'constant' AS strategy, hour(date_trunc('hour', ts))::DOUBLE AS target_rate,
         count(*)::DOUBLE AS rps_median, median(value) AS latency_median_s, max(value) AS ttft_median_ms,
         min(value) AS itl_median_ms, avg(value) AS output_tps_median, sum(floor(value))::DOUBLE AS total_output_tokens
  FROM events GROUP BY event_type, date_trunc('hour', ts)
  HAVING hour(date_trunc('hour', ts)) <> 0)"""


@register("E9_S13_sweep_rows", f"""
WITH {_SWEEP_SQL}
SELECT subset, strategy, target_rate, rps_median, (floor((latency_median_s) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS latency_median_s,
       ttft_median_ms, itl_median_ms, (floor((output_tps_median) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS output_tps_median, total_output_tokens FROM sw""")
def e9(spark, sf):
    b = _bench_docs(spark, sf)
    s = E.sweep_rows(b, E.subset_from_filename(F.col("file")))
    return s.withColumn("latency_median_s", r6(F.col("latency_median_s"))).withColumn(
        "output_tps_median", r6(F.col("output_tps_median")))


@register("E10_attach_acceptance", _DELTA + f""",
{_SWEEP_SQL}
SELECT sw.subset, sw.target_rate, sw.rps_median, (floor((s.acceptance_length) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS acceptance_length
FROM sw LEFT JOIN scal2 s USING (subset)""")
def e10(spark, sf):
    s = E.sweep_rows(_bench_docs(spark, sf), E.subset_from_filename(F.col("file")))
    scal, _ = E.acceptance_rates(_delta(spark, sf), KEY)
    j = E.attach_acceptance(s, scal.select("subset", "acceptance_length"))
    return j.select("subset", "target_rate", "rps_median", r6(F.col("acceptance_length")).alias("acceptance_length"))


_PTS = f"""
WITH {sweep_points_cte()},
pts AS (SELECT label, regexp_replace(subset, '^run_', '') AS subset, x, y FROM sweep WHERE strategy = 'constant')"""


def _points(spark, sf):
    return E.chart_points(D.sweep_points(spark, sf), "latency", "rps_median")


@register("E11_chart_points", _PTS + "\nSELECT label, subset, x, (floor((y) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS y FROM pts")
def e11(spark, sf):
    return _points(spark, sf).withColumn("y", r6(F.col("y")))


@register("E12_pool_points", _PTS + """
SELECT label, subset, x, (floor((avg(y)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS y FROM pts GROUP BY label, subset, x
UNION ALL SELECT label, '__all__', x, (floor((avg(y)) * 1000000.000001::DOUBLE + 0.5) / 1e6) FROM pts GROUP BY label, x""")
def e12(spark, sf):
    return E.pool_points(_points(spark, sf)).withColumn("y", r6(F.col("y")))


@register("E13_E14_choose_subsets", _PTS + """
SELECT subset, subset AS pretty FROM (
  SELECT DISTINCT subset FROM pts WHERE label = '0' INTERSECT SELECT DISTINCT subset FROM pts WHERE label = '1')""")
def e13(spark, sf):
    s = E.choose_subsets(_points(spark, sf), "0", "1", "intersection")
    return s.select("subset", E.pretty_subset(F.col("subset")).alias("pretty"))


@register("E15_E16_interpolated_speedup", _PTS + """,
p AS (SELECT label, subset, x, avg(y) AS y FROM pts GROUP BY label, subset, x),
rng AS (
  SELECT subset, greatest(min(x) FILTER (WHERE label = '0'), min(x) FILTER (WHERE label = '1')) AS lo,
         least(max(x) FILTER (WHERE label = '0'), max(x) FILTER (WHERE label = '1')) AS hi
  FROM p GROUP BY subset HAVING lo < hi),
grid AS (SELECT subset, gi, lo + (hi - lo) * gi / 199.0 AS x FROM rng, (SELECT unnest(generate_series(0, 199)) AS gi)),
gl AS (SELECT g.*, l.label FROM grid g, (SELECT unnest(['0', '1']) AS label) l),
iv AS (
  SELECT g.label, g.subset, g.gi, g.x,
    (SELECT struct_pack(x := p.x, y := p.y) FROM p WHERE p.label = g.label AND p.subset = g.subset AND p.x <= g.x ORDER BY p.x DESC LIMIT 1) AS p0,
    (SELECT struct_pack(x := p.x, y := p.y) FROM p WHERE p.label = g.label AND p.subset = g.subset AND p.x > g.x ORDER BY p.x LIMIT 1) AS p1
  FROM gl g),
yi AS (SELECT label, subset, gi, x, CASE WHEN p1 IS NULL OR p1.x = p0.x THEN p0.y
            ELSE p0.y + (p1.y - p0.y) * (x - p0.x) / (p1.x - p0.x) END AS y FROM iv)
SELECT b.subset, b.gi::BIGINT AS gi, (floor((b.x) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS x, (floor((b.y) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS y_baseline, (floor((t.y) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS y_target,
       (floor((b.y / greatest(t.y, 1e-12)) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS speedup
FROM yi b JOIN yi t ON t.subset = b.subset AND t.gi = b.gi AND t.label = '1' WHERE b.label = '0'""")
def e15(spark, sf):
    s = E.interpolate_speedup(_points(spark, sf), "0", "1", increasing=True)
    return s.select("subset", F.col("gi").cast("bigint").alias("gi"), r6(F.col("x")).alias("x"),
                    r6(F.col("y_baseline")).alias("y_baseline"), r6(F.col("y_target")).alias("y_target"),
                    r6(F.col("speedup")).alias("speedup"))


def _cubic_sql() -> str:
    """The same least squares in DuckDB: sums, then Gauss-Jordan steps."""
    t = ["1.0", "u", "(2 * u * u - 1)", "((4 * u * u - 3) * u)"]
    cols = [(i, j) for i in range(4) for j in range(5)]
    sums = ", ".join(f"CASE WHEN any_value(xs) > {max(i, j % 4 if j < 4 else 0)} THEN sum({t[i]} * {t[j] if j < 4 else 'y'}) "
                     f"ELSE {float(i == j)} END AS m{i}{j}" for i, j in cols)
    ctes = [f"""spans AS (SELECT label, subset, min(x) AS lo, max(x) AS hi, count(*) AS n, count(DISTINCT x) AS xs FROM pts GROUP BY ALL),
unit AS (SELECT *, CASE WHEN hi > lo THEN (2.0 * x - lo - hi) / (hi - lo) ELSE 0.0 END AS u FROM pts JOIN spans USING (label, subset)),
s0 AS (SELECT label, subset, {sums} FROM unit GROUP BY label, subset)"""]
    for p in range(4):
        new = [f"m{i}{j} / m{p}{p} AS m{i}{j}" if i == p else f"m{i}{j} - m{i}{p} * m{p}{j} / m{p}{p} AS m{i}{j}" for i, j in cols]
        ctes.append(f"s{p + 1} AS (SELECT label, subset, {', '.join(new)} FROM s{p})")
    ctes.append("""grid AS (SELECT label, subset, gi, lo, hi, CASE WHEN gi = 299 THEN hi ELSE lo + (hi - lo) * gi / 299 END AS x
  FROM spans, (SELECT unnest(range(300)) AS gi) WHERE gi = 0 OR n > 1),
placed AS (SELECT *, CASE WHEN hi > lo THEN (2.0 * x - lo - hi) / (hi - lo) ELSE 0.0 END AS u FROM grid)""")
    y = " + ".join(f"m{i}4 * {t[i]}" for i in range(4))
    return ", ".join(ctes) + f"""
SELECT label, subset, gi, (floor(x * 1000000.000001::DOUBLE + 0.5) / 1e6) AS x, (floor(({y}) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS y_smooth
FROM placed JOIN s4 USING (label, subset)"""


@register("E17_smooth_curve", _PTS + ",\n" + _cubic_sql())
def e17(spark, sf):
    c = E.smooth_curve(_points(spark, sf))
    return c.select("label", "subset", "gi", r6(F.col("x")).alias("x"), r6(F.col("y_smooth")).alias("y_smooth"))


# Per-position acceptance thresholds of the regression gate.
THRESHOLDS = [0.4, 0.1, 0.01]


@register("E18_acceptance_gate", _DELTA + """,
th AS (SELECT * FROM (VALUES (0, 0.4), (1, 0.1), (2, 0.01)) t(position, threshold)),
need AS (SELECT s.subset, th.position, th.threshold FROM (SELECT DISTINCT subset FROM pos) s, th),
j AS (SELECT n.subset, p.rate IS NULL OR p.rate < n.threshold AS fail FROM need n LEFT JOIN pos p USING (subset, position))
SELECT subset, count(*) FILTER (WHERE fail)::BIGINT AS n_failed, count(*) FILTER (WHERE fail) = 0 AS passed
FROM j GROUP BY subset""")
def e18(spark, sf):
    _scal, pos = E.acceptance_rates(_delta(spark, sf), KEY)
    return E.acceptance_gate(pos, THRESHOLDS, KEY)


@register("E19_acceptance_report", _DELTA + """
SELECT subset, 0::BIGINT AS line_no, 'Num drafts' AS item, (floor((num_drafts) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS value FROM scal2
UNION ALL SELECT subset, 1, 'Num draft tokens', (floor((num_draft_tokens) * 1000000.000001::DOUBLE + 0.5) / 1e6) FROM scal2
UNION ALL SELECT subset, 2, 'Num accepted tokens', (floor((num_accepted_tokens) * 1000000.000001::DOUBLE + 0.5) / 1e6) FROM scal2
UNION ALL SELECT subset, 3, 'Acceptance length', (floor((acceptance_length) * 1000000.000001::DOUBLE + 0.5) / 1e6) FROM scal2
UNION ALL SELECT subset, position + 4, 'Position ' || position::VARCHAR, (floor((rate) * 1000000.000001::DOUBLE + 0.5) / 1e6) FROM pos""")
def e19(spark, sf):
    scal, pos = E.acceptance_rates(_delta(spark, sf), KEY)
    r = E.acceptance_report(scal, pos, KEY)
    return r.select("subset", F.col("line_no").cast("bigint").alias("line_no"), "item", r6(F.col("value")).alias("value"))


@register("E20_subset_from_filename", r"""
WITH n AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN '/r/sweeps_' || source || '.json'
                           WHEN 'fr' THEN '/r/gen_len_' || source || '.json'
                           WHEN 'de' THEN '/r/sweep_' || source || '.json'
                           ELSE '/r/' || source || '.csv' END AS path FROM documents)
SELECT doc_id, CASE WHEN regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(?:gen_len|sweeps?)_(.+)\.json$', 1) <> ''
                    THEN regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(?:gen_len|sweeps?)_(.+)\.json$', 1)
                    ELSE regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') END AS subset
FROM n""")
def e20(spark, sf):
    d = table(spark, sf, "documents")
    path = (F.when(F.col("lang") == "en", F.concat(F.lit("/r/sweeps_"), F.col("source"), F.lit(".json")))
             .when(F.col("lang") == "fr", F.concat(F.lit("/r/gen_len_"), F.col("source"), F.lit(".json")))
             .when(F.col("lang") == "de", F.concat(F.lit("/r/sweep_"), F.col("source"), F.lit(".json")))
             .otherwise(F.concat(F.lit("/r/"), F.col("source"), F.lit(".csv"))))
    return d.select("doc_id", E.subset_from_filename(path).alias("subset"))


@register("E21_total_output_tokens", f"""
SELECT conv_id, sum(len(regexp_extract_all(text, {TOKEN_RE})))::BIGINT AS total_num_output_tokens
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def e21(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant").withColumn("tokens", tokenize("text"))
    return E.total_output_tokens(c, "tokens", ["conv_id"])


@register("E22_subsets_with_drafts", _DELTA + """
SELECT subset, (floor((num_drafts) * 1000000.000001::DOUBLE + 0.5) / 1e6) AS num_drafts FROM scal2 WHERE num_drafts > 0""")
def e22(spark, sf):
    scal, _ = E.acceptance_rates(_delta(spark, sf), KEY)
    return E.subsets_with_drafts(scal).select("subset", r6(F.col("num_drafts")).alias("num_drafts"))
