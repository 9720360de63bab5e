"""Serving-evaluation analytics: counter scrapes, acceptance rates, sweep
tables, interpolated speedups.  One job covers every run and subset at once
(the grouping keys carry run/subset), instead of a loop per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftkit.session import materialize
from draftkit.functions.joins import checked_broadcast_join

# Counter-line patterns, the serving engine's metric prefix and
# counter names, skipped sweep strategies, metric directions, pretty names.
RE_SIMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)\s+([0-9.eE+-]+)$"
RE_LABELED = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)\{([^}]+)\}\s+([0-9.eE+-]+)$"
SPEC_PREFIX = "vllm:spec_decode"
N_DRAFTS = "vllm:spec_decode_num_drafts"
N_DRAFT_TOKENS = "vllm:spec_decode_num_draft_tokens"
N_ACCEPTED = "vllm:spec_decode_num_accepted_tokens"
N_PER_POS = "vllm:spec_decode_num_accepted_tokens_per_pos"
SKIP_STRATEGIES = ("throughput",)
METRICS = {
    "latency": {"csv_col": "latency_median_s", "json_key": "request_latency", "increasing": True},
    "itl": {"csv_col": "itl_median_ms", "json_key": "inter_token_latency_ms", "increasing": True},
    "ttft": {"csv_col": "ttft_median_ms", "json_key": "time_to_first_token_ms", "increasing": True},
    "output_tps": {"csv_col": "output_tps_median", "json_key": "output_tokens_per_second", "increasing": False},
}
PRETTY_SUBSET_NAMES = {
    "HumanEval": "HumanEval",
    "math_reasoning": "Math Reasoning",
    "qa": "QA",
    "question": "Question",
    "rag": "RAG",
    "summarization": "Summarization",
    "tool_call": "Tool Call",
    "translation": "Translation",
    "writing": "Writing",
}


# ------------------------------------------------------------------ E1 / E2
def parse_counter_lines(lines: DataFrame, key_cols: list[str], line_col: str = "value") -> DataFrame:
    """Counter text rows -> ``(key..., name, position, value)``.

    Comment and blank lines are skipped; only names containing the prefix
    are kept, with every ``_total`` removed from the name; values that do
    not match the number pattern (``NaN``, ``Inf``) drop the line.
    Per-position counters need a ``position="n"`` label; others get a NULL
    position.
    """
    line = F.trim(F.col(line_col))
    simple_name = F.regexp_extract(line, RE_SIMPLE, 1)
    lab_name = F.regexp_extract(line, RE_LABELED, 1)
    is_simple = simple_name != ""
    name_raw = F.when(is_simple, simple_name).otherwise(lab_name)
    labels = F.when(is_simple, F.lit(None)).otherwise(F.regexp_extract(line, RE_LABELED, 2))
    val_txt = F.when(is_simple, F.regexp_extract(line, RE_SIMPLE, 2)).otherwise(F.regexp_extract(line, RE_LABELED, 3))
    d = lines.select(*key_cols, name_raw.alias("_raw"), labels.alias("_labels"),
                     val_txt.try_cast("double").alias("value"))
    d = d.filter((F.col("_raw") != "") & F.col("_raw").contains(SPEC_PREFIX) & F.col("value").isNotNull())
    d = d.withColumn("name", F.regexp_replace("_raw", "_total", ""))
    pos = F.regexp_extract(F.coalesce(F.col("_labels"), F.lit("")), r'position="(\d+)"', 1)
    per_pos = F.col("name").contains("per_pos")
    d = d.withColumn("position", F.when(per_pos & (pos != ""), pos.cast("int")))
    d = d.filter(~per_pos | F.col("position").isNotNull())
    return d.select(*key_cols, "name", "position", "value")


def scrape_totals(parsed: DataFrame, key_cols: list[str], duplicates: str = "max") -> DataFrame:
    """Scalar counters summed over label sets; per-position counters as
    a dense vector from 0 to the largest position (gaps 0).  Duplicate
    positions: ``max`` (largest wins, as the reference) or ``sum``.
    Output long form ``(key..., name, position, value)``."""
    per = parsed.groupBy(*key_cols, "name", "position").agg(F.sum("value").alias("s"), F.max("value").alias("m"))
    # one row per counter: its positions are as many as draft tokens
    at = F.col("position").isNotNull()
    one = per.groupBy(*key_cols, "name").agg(
        F.max("position").alias("_last"), F.max(F.when(~at, F.col("s"))).alias("_scalar"),
        F.map_from_entries(F.collect_list(F.when(at, F.struct("position", F.col("m" if duplicates == "max" else "s"))))).alias("_at"))
    entry = lambda pos, v: F.struct(pos.cast("int").alias("position"), v.alias("value"))
    none = F.array().cast("array<struct<position:int,value:double>>")
    scalar = F.when(F.col("_scalar").isNotNull(), F.array(entry(F.lit(None), F.col("_scalar")))).otherwise(none)
    dense = F.when(F.col("_last").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))), lambda i: entry(i, F.coalesce(F.try_element_at("_at", i), F.lit(0.0))))).otherwise(none)
    return one.select(*key_cols, "name", F.inline(F.concat(scalar, dense)))


# ------------------------------------------------------------------ E3 - E6
def subtract_baseline(after: DataFrame, before: DataFrame, key_cols: list[str]) -> DataFrame:
    """``after - before`` per (name, position); what is missing on one
    side counts as 0, so the shorter vector is zero-extended."""
    both = after.withColumn("_sign", F.lit(1.0)).unionByName(before.withColumn("_sign", F.lit(-1.0)))
    return both.groupBy(*key_cols, "name", "position").agg(F.sum(F.col("value") * F.col("_sign")).alias("value"))


def acceptance_rates(totals: DataFrame, key_cols: list[str], no_drafts_length: float = 0.0,
                     pos_prefix: str = "acceptance_at_pos_") -> DataFrame:
    """Per key ``num_drafts``, ``num_draft_tokens``,
    ``num_accepted_tokens``, ``acceptance_length = 1 + accepted/drafts``
    (``no_drafts_length`` without drafts: 0 for the evaluator, 1 for the
    test variant) and long-form per-position rates ``count_i / drafts``."""
    value = lambda name: F.sum(F.when(F.col("position").isNull() & (F.col("name") == name), F.col("value")).otherwise(0.0))
    per_pos = F.col("position").isNotNull() & F.col("name").contains("per_pos")
    # one pass over the totals: the few positions of a key travel in its row
    g = totals.groupBy(*key_cols).agg(
        F.count_if(F.col("position").isNull()).alias("_n"), value(N_DRAFTS).alias("num_drafts"), value(N_DRAFT_TOKENS).alias("num_draft_tokens"),
        value(N_ACCEPTED).alias("num_accepted_tokens"), F.collect_list(F.when(per_pos, F.struct("position", "value"))).alias("_p"))
    scal = g.filter(F.col("_n") > 0).drop("_n", "_p").withColumn("acceptance_length", F.when(
        F.col("num_drafts") > 0, F.lit(1.0) + F.col("num_accepted_tokens") / F.col("num_drafts")).otherwise(F.lit(no_drafts_length)))
    pos = g.select(*key_cols, "num_drafts", F.inline("_p")).groupBy(*key_cols, "num_drafts", "position").agg(F.sum("value").alias("count"))
    pos = pos.select(
        *key_cols, "position", F.concat(F.lit(pos_prefix), F.col("position").cast("string")).alias("metric"),
        F.when(F.col("num_drafts") > 0, F.col("count") / F.col("num_drafts")).otherwise(F.lit(0.0)).alias("rate"))
    return scal, pos


def acceptance_wide(scal: DataFrame, pos: DataFrame, key_cols: list[str], num_positions: int,
                    pos_prefix: str = "acceptance_at_pos_") -> DataFrame:
    """One wide row per key with contiguous position columns."""
    names = [f"{pos_prefix}{i}" for i in range(num_positions)]
    wide = pos.groupBy(*key_cols).pivot("metric", names).agg(F.first("rate"))
    return scal.join(wide, key_cols, "left")


# ------------------------------------------------------------------ E7 / E8
def output_length_stats(lengths: DataFrame, key_cols: list[str], len_col: str = "output_tokens") -> DataFrame:
    """Count, exact (interpolated) median, min, max and
    ``max_tokens = 2^ceil(log2(max(median, 1)))`` per key.  Keys without
    lengths do not appear (the caller treats that as an error)."""
    g = lengths.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("count"), F.median(len_col).alias("median"),
        F.min(len_col).alias("min"), F.max(len_col).alias("max"))
    return g.withColumn("max_tokens", max_tokens_for(F.col("median")))


def max_tokens_for(median: Column) -> Column:
    """E8."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(median, F.lit(1.0))))).cast("bigint")


# ------------------------------------------------------------------ E9 - E11
def sweep_rows(bench: DataFrame, subset: Column) -> DataFrame:
    """One row per benchmark entry (after ``inline``), skipped
    strategies removed, five successful-request medians and the output-token
    sum (missing values are NULL)."""
    m = F.col("metrics")
    kind = F.coalesce(F.col("config.strategy.type_"), F.lit("unknown"))
    med = lambda k: m[k]["successful"]["median"]
    return bench.filter(~kind.isin(*SKIP_STRATEGIES)).select(
        subset.alias("subset"), kind.alias("strategy"),
        F.col("config.strategy.rate").alias("target_rate"),
        med("requests_per_second").alias("rps_median"),
        med("request_latency").alias("latency_median_s"),
        med("time_to_first_token_ms").alias("ttft_median_ms"),
        med("inter_token_latency_ms").alias("itl_median_ms"),
        med("output_tokens_per_second").alias("output_tps_median"),
        m["output_tokens"]["successful"]["sum"].alias("total_output_tokens"))


def gen_len_lengths(docs: DataFrame, subset: Column) -> DataFrame:
    """E7 input: output-token counts of the successful requests of the
    *first* benchmark of each gen-len document."""
    first = F.element_at("benchmarks", 1)
    return docs.select(subset.alias("subset"), F.explode_outer(first["requests"]["successful"]).alias("r")).select(
        "subset", F.col("r.output_tokens").alias("output_tokens")).filter(F.col("output_tokens").isNotNull())


def json_chart_points(bench: DataFrame, metric: str, stat: str = "median") -> DataFrame:
    """E11 (JSON form): constant-rate entries; x = mean requests per second,
    y = the metric's successful ``stat``; subset = stem of the run's data
    file; entries missing either value are dropped."""
    key = METRICS[metric]["json_key"]
    subset = F.regexp_replace(F.regexp_extract(F.col("data_files"), r"([^/]+)$", 1), r"\.[^.]*$", "")
    d = bench.filter(F.col("config.strategy.type_") == "constant").select(
        subset.alias("subset"), F.col("metrics.requests_per_second.successful.mean").alias("x"),
        F.col("metrics")[key]["successful"][stat].alias("y"))
    return d.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def attach_acceptance(sweep: DataFrame, acceptance: DataFrame, key: str = "subset") -> DataFrame:
    """Add the per-subset acceptance columns to every sweep row
    (one row per subset: broadcast after a size check)."""
    return checked_broadcast_join(sweep, acceptance, key, "left")


def chart_points(rows: DataFrame, metric: str, x_col: str = "rps_median") -> DataFrame:
    """Keep ``constant`` strategy rows, strip ``run_`` from subsets,
    drop rows whose x or y does not parse."""
    y = METRICS[metric]["csv_col"]
    d = rows.filter(F.col("strategy") == "constant").select(
        "label", F.regexp_replace(F.coalesce(F.col("subset"), F.lit("unknown")), "^run_", "").alias("subset"),
        F.expr(f"try_cast(`{x_col}` AS DOUBLE)").alias("x"), F.expr(f"try_cast(`{y}` AS DOUBLE)").alias("y"))
    return d.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


# ------------------------------------------------------------------ E12 - E14
ALL_SUBSETS = "__all__"


def pool_points(points: DataFrame) -> DataFrame:
    """Repetitions pooled per (label, subset), plus one pooled curve of
    all subsets per label -- both levels in one aggregation
    (``GROUPING SETS``); duplicate x are averaged."""
    g = points.groupingSets([["label", "subset", "x"], ["label", "x"]], "label", "subset", "x").agg(
        F.avg("y").alias("y"), F.grouping_id().alias("_g"))
    return g.select("label", F.when(F.col("_g") == 0, F.col("subset")).otherwise(F.lit(ALL_SUBSETS)).alias("subset"),
                    "x", "y")


def choose_subsets(points: DataFrame, baseline: str, target: str, mode: str = "intersection",
                   only: list[str] | None = None) -> DataFrame:
    """Subsets present for the baseline and target labels: their union
    or intersection; optional explicit filter."""
    b = points.filter(F.col("label") == baseline).select("subset").distinct()
    t = points.filter(F.col("label") == target).select("subset").distinct()
    s = b.intersect(t) if mode == "intersection" else b.union(t).distinct()
    if only:
        s = s.filter(F.col("subset").isin(*only))
    return s


def pretty_subset(col: Column) -> Column:
    """Pretty name, defaulting to the name itself."""
    items = []
    for k, v in PRETTY_SUBSET_NAMES.items():
        items += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*items), col), col)


# ------------------------------------------------------------------ E15 - E17
def interpolate_speedup(points: DataFrame, baseline: str, target: str, increasing: bool,
                        n_grid: int = 200, eps: float = 1e-12) -> DataFrame:
    """Per subset, a grid of ``n_grid`` x values over the overlap of
    the two curves (none when ``lo >= hi``), both curves linearly
    interpolated, and the speedup (``base/target`` when smaller is better,
    else ``target/base``; divisor floored at ``eps``).

    Interpolation is an as-of join without pairs: grid rows and curve points
    are unioned per curve, sorted by x, and each grid row takes the last
    point at or before it and the first point after it (window bounded by
    one curve's points plus the grid).
    """
    pts = materialize(points.filter(F.col("label").isin(baseline, target)).groupBy("label", "subset", "x").agg(F.avg("y").alias("y")), "curves")
    rng = pts.groupBy("subset").agg(
        F.min(F.when(F.col("label") == baseline, F.col("x"))).alias("_b0"),
        F.max(F.when(F.col("label") == baseline, F.col("x"))).alias("_b1"),
        F.min(F.when(F.col("label") == target, F.col("x"))).alias("_t0"),
        F.max(F.when(F.col("label") == target, F.col("x"))).alias("_t1"))
    rng = rng.select("subset", F.greatest("_b0", "_t0").alias("lo"), F.least("_b1", "_t1").alias("hi")).filter(
        F.col("lo") < F.col("hi"))
    grid = rng.select("subset", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("gi"))
    grid = grid.select("subset", "gi", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("gi") / F.lit(n_grid - 1)).alias("x"))
    labels = F.array(F.lit(baseline), F.lit(target))
    gl = grid.select("subset", "gi", "x", F.explode(labels).alias("label"))
    u = (gl.select("label", "subset", "x", "gi", F.lit(None).cast("double").alias("y"), F.lit(1).alias("_isg"))
           .unionByName(pts.join(rng.select("subset"), "subset", "left_semi")
                        .select("label", "subset", "x", F.lit(None).cast("int").alias("gi"), "y", F.lit(0).alias("_isg"))))
    # running "last point so far" up the curve and down it: both frames grow
    # row by row, so a curve takes one pass each way
    up = Window.partitionBy("label", "subset").orderBy("x", "_isg").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("label", "subset").orderBy(F.col("x").desc(), F.col("_isg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    pt = F.when(F.col("_isg") == 0, F.struct("x", "y"))
    u = u.withColumn("_p0", F.last(pt, ignorenulls=True).over(up)).withColumn("_p1", F.last(pt, ignorenulls=True).over(down))
    g = u.filter(F.col("_isg") == 1)
    x0, y0, x1, y1 = F.col("_p0.x"), F.col("_p0.y"), F.col("_p1.x"), F.col("_p1.y")
    yi = F.when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (y1 - y0) * (F.col("x") - x0) / (x1 - x0))
    g = g.select("label", "subset", "gi", "x", yi.alias("y"))
    j = g.groupBy("subset", "gi", "x").agg(F.max(F.when(F.col("label") == baseline, F.col("y"))).alias("y_baseline"),
                                           F.max(F.when(F.col("label") == target, F.col("y"))).alias("y_target"))
    e = F.lit(eps)
    sp = (F.col("y_baseline") / F.greatest(F.col("y_target"), e)) if increasing else \
        (F.col("y_target") / F.greatest(F.col("y_baseline"), e))
    return j.withColumn("speedup", sp)


def smooth_curve(points: DataFrame, n_dense: int = 300, keys: tuple[str, ...] = ("label", "subset")) -> DataFrame:
    """The smoothed curve of each group on ``n_dense`` evenly spaced x
    values: ``(keys..., gi, x, y_smooth)``.

    A cubic smoothing spline that may leave squared residuals of n * var(y)
    adds no inner knot: the least-squares cubic never leaves more than the
    mean does.  So the curve is that cubic, for any number of points.  Its
    coefficients come from sums that Spark adds up with map-side combine (x
    scaled to [-1, 1], Chebyshev polynomials, so the 4x4 system is well
    conditioned) and are solved in columns.

    A group of one point comes back as it is (``gi`` 0).  Fewer than four
    distinct x have no one cubic (the spline fit refuses them): the
    polynomial has one degree less than there are distinct x.  Points without
    x or y are left out; points of equal x all count.
    """
    keys = list(keys)
    pts = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    span = pts.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.countDistinct("x").alias("_xs"))
    span = materialize(span, "curve-spans")
    d = checked_broadcast_join(pts, span.select(*keys, "_lo", "_hi"), keys)
    d = d.withColumn("_t", _chebyshev(_scaled(F.col("x"), F.col("_lo"), F.col("_hi"))))
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    sums = d.groupBy(*keys).agg(*[F.sum(F.col("_t")[i] * F.col("_t")[j]).alias(f"_g{i}{j}") for i, j in pairs],
                                *[F.sum(F.col("_t")[i] * F.col("y")).alias(f"_r{i}") for i in range(4)])
    fit = checked_broadcast_join(sums, span, keys)
    # basis functions beyond the degree become equations of their own
    used = [F.col("_xs") > i for i in range(4)]
    fit = fit.withColumns({**{f"_g{i}{j}": F.when(used[i], F.col(f"_g{i}{j}")).otherwise(float(i == j)) for i, j in pairs},
                           **{f"_r{i}": F.when(used[i], F.col(f"_r{i}")).otherwise(0.0) for i in range(4)}})
    for i in range(4):  # Cholesky factor by rows, with the forward solve
        for j in range(i):
            inner = sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
            fit = fit.withColumn(f"_l{i}{j}", (F.col(f"_g{i}{j}") - inner) / F.col(f"_l{j}{j}"))
        inner = sum((F.col(f"_l{i}{k}") * F.col(f"_l{i}{k}") for k in range(i)), F.lit(0.0))
        fit = fit.withColumn(f"_l{i}{i}", F.sqrt(F.col(f"_g{i}{i}") - inner))
        inner = sum((F.col(f"_l{i}{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        fit = fit.withColumn(f"_z{i}", (F.col(f"_r{i}") - inner) / F.col(f"_l{i}{i}"))
    for i in range(3, -1, -1):
        inner = sum((F.col(f"_l{k}{i}") * F.col(f"_c{k}") for k in range(i + 1, 4)), F.lit(0.0))
        fit = fit.withColumn(f"_c{i}", (F.col(f"_z{i}") - inner) / F.col(f"_l{i}{i}"))
    last = F.lit(n_dense - 1)
    grid = fit.select(*keys, "_n", "_lo", "_hi", *[f"_c{i}" for i in range(4)],
                      F.explode(F.sequence(F.lit(0), F.when(F.col("_n") < 2, F.lit(0)).otherwise(last))).alias("gi"))
    grid = grid.withColumn("x", F.when(F.col("gi") == last, F.col("_hi")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("gi") / last))
    t = _chebyshev(_scaled(F.col("x"), F.col("_lo"), F.col("_hi")))
    return grid.select(*keys, "gi", "x", sum((F.col(f"_c{i}") * t[i] for i in range(1, 4)), F.col("_c0")).alias("y_smooth"))


def _scaled(x: Column, lo: Column, hi: Column) -> Column:
    """x on [-1, 1]; 0 where the curve has one x."""
    return F.when(hi > lo, (F.lit(2.0) * x - lo - hi) / (hi - lo)).otherwise(0.0)


def _chebyshev(u: Column) -> Column:
    """The first four Chebyshev polynomials."""
    return F.array(F.lit(1.0), u, F.lit(2.0) * u * u - 1.0, (F.lit(4.0) * u * u - 3.0) * u)


# ------------------------------------------------------------------ E18 - E22
def acceptance_gate(rates: DataFrame, thresholds: list[float], key_cols: list[str]) -> DataFrame:
    """Position ``i`` must reach ``thresholds[i]``; a missing position
    fails.  ``rates``: ``(key..., position, rate)``.  The thresholds are a
    literal array exploded per key (a handful of entries)."""
    th = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(float(t)).alias("threshold"))
                   for i, t in enumerate(thresholds)])
    need = rates.select(*key_cols).distinct().select(*key_cols, F.inline(th))
    j = need.join(rates, [*key_cols, "position"], "left")
    fail = F.col("rate").isNull() | (F.col("rate") < F.col("threshold"))
    return j.groupBy(*key_cols).agg(F.count_if(fail).cast("bigint").alias("n_failed"),
                                    (F.count_if(fail) == 0).alias("passed"))


def acceptance_report(scal: DataFrame, pos: DataFrame, key_cols: list[str]) -> DataFrame:
    """The four totals and the per-position rates as ordered report
    lines ``(key..., line_no, item, value)``."""
    tot = scal.select(*key_cols, F.expr(
        "stack(4, 0, 'Num drafts', num_drafts, 1, 'Num draft tokens', num_draft_tokens, "
        "2, 'Num accepted tokens', num_accepted_tokens, 3, 'Acceptance length', acceptance_length)"
    ).alias("line_no", "item", "value"))
    p = pos.select(*key_cols, (F.col("position") + 4).alias("line_no"),
                   F.concat(F.lit("Position "), F.col("position").cast("string")).alias("item"),
                   F.col("rate").alias("value"))
    return tot.unionByName(p)


def subset_from_filename(path: Column) -> Column:
    """``gen_len_X.json`` / ``sweep_X.json`` / ``sweeps_X.json`` -> X,
    else the file stem."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    m = F.regexp_extract(name, r"(?:gen_len|sweeps?)_(.+)\.json$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(m != "", m).otherwise(stem)


def total_output_tokens(df: DataFrame, tokens_col: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """E21."""
    return df.groupBy(*(by or [])).agg(F.sum(F.size(tokens_col)).cast("bigint").alias("total_num_output_tokens"))


def subsets_with_drafts(scal: DataFrame) -> DataFrame:
    """Only subsets with drafts are written; none at all is an error
    (checked with one ``limit(1)`` probe)."""
    kept = scal.filter(F.col("num_drafts") > 0)
    # decided in the plan: one scalar of the same rows beside them
    some = scal.agg(F.assert_true(F.coalesce(F.max("num_drafts"), F.lit(0)) > 0, F.lit("no subset produced drafts")).alias("_ok"))
    return kept.crossJoin(F.broadcast(some)).filter(F.col("_ok").isNull()).drop("_ok")
