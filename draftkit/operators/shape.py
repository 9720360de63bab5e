"""Sequence shaping: per-sample array work and long-form window work.

A sample is bounded by the maximum sequence length, so per-sample arrays are
handled with higher-order array functions inside one row (no shuffle).
Operations that relate several samples (collate, packing boundaries) or that
need a random choice among positions use long form with keyed hash draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit.functions.arrays import drop_first, drop_last, pad_or_cut, positions, shift_left
from draftkit.functions.keys import draw_uniform, hash32, order_key

IGNORE_INDEX = -100


# ------------------------------------------------------------------ Q1 / Q2
def sample_lengths(df: DataFrame, key: str = "sample_idx") -> DataFrame:
    """Q1: the ``(key, seq_len)`` projection (column-pruned at the scan)."""
    return df.select(key, "seq_len")


def with_positions(df: DataFrame, len_col: str = "seq_len") -> DataFrame:
    """Q2: ``lengths = [n]``, ``position_ids = 0..n-1`` (empty for n = 0)."""
    return (df.withColumn("lengths", F.array(F.col(len_col).cast("int")))
              .withColumn("position_ids", positions(F.col(len_col))))


# ------------------------------------------------------------------ Q3 / Q4
def split_layers_long(df: DataFrame, key: str = "sample_idx") -> DataFrame:
    """Q3: long-form hidden states ``(key, pos, layer, vec)`` -> per position
    ``hidden_states`` = concatenation of all layers but the last, and
    ``verifier_last_hidden_states`` = the last layer.  A group is one
    position (bounded by the layer count)."""
    g = (df.groupBy(key, "pos")
           .agg(F.sort_array(F.collect_list(F.struct("layer", "vec"))).alias("_l")))
    n = F.size("_l")
    return g.select(key, "pos",
                    F.flatten(F.transform(F.slice("_l", 1, n - 1), lambda x: x["vec"])).alias("hidden_states"),
                    F.element_at("_l", -1)["vec"].alias("verifier_last_hidden_states"))


def split_layers_nested(layers: Column) -> tuple[Column, Column]:
    """Q4: ``[L][h]`` per position -> (concat of first L-1, last)."""
    n = F.size(layers)
    return F.flatten(F.slice(layers, 1, n - 1)), F.element_at(layers, -1)


# ------------------------------------------------------------------ Q5 / Q6 / Q7
def cut_or_pad(col, length: int, pad=0) -> Column:
    """Q5: right cut / zero pad to ``length``."""
    return pad_or_cut(col, length, pad)


def next_token_shift(df: DataFrame) -> DataFrame:
    """Q6: align token t+1 with hidden state t: drop the first id, mask,
    verifier state and position, the last hidden state; length - 1 clamped
    at 0."""
    out = df
    for c in ("input_ids", "loss_mask", "position_ids", "verifier_last_hidden_states"):
        if c in df.columns:
            out = out.withColumn(c, drop_first(c))
    if "hidden_states" in df.columns:
        out = out.withColumn("hidden_states", drop_last("hidden_states"))
    if "lengths" in df.columns:
        out = out.withColumn("lengths", F.transform("lengths", lambda x: F.greatest(x - 1, F.lit(0))))
    return out


def mtp_view(df: DataFrame) -> DataFrame:
    """Q7: MTP input: the last hidden state is the model input, no shift."""
    return df.withColumnRenamed("verifier_last_hidden_states", "hidden_states_last") if \
        "verifier_last_hidden_states" in df.columns else df


# ------------------------------------------------------------------ Q8 / Q9
def uniform_noise(vec: Column, seed: int, key: Column, std: float = 0.05) -> Column:
    """Q8: ``x + 2(u - 1/2) std``, ``u`` a keyed draw of (seed, key, index)."""
    return F.transform(vec, lambda x, i: x.cast("double") + F.lit(2.0) * (draw_uniform(seed, key, i) - F.lit(0.5)) * F.lit(std))


def gaussian_noise(vec: Column, seed: int, key: Column, std: float = 0.05) -> Column:
    """Q8: ``x + n std`` with ``n`` standard normal from two keyed draws
    (Box-Muller)."""
    def one(x, i):
        u1 = (hash32(seed, key, i, F.lit("a")) + F.lit(1)) / F.lit(4294967297.0)
        u2 = draw_uniform(seed, key, i, F.lit("b"))
        n = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
        return x.cast("double") + n * F.lit(std)
    return F.transform(vec, one)


def cast_hidden(df: DataFrame, dtype: str = "array<float>") -> DataFrame:
    """Q9: cast only columns whose name contains ``hidden_states``."""
    return df.select(*[F.col(c).cast(dtype).alias(c) if "hidden_states" in c else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ Q10 - Q13
def collate(members: DataFrame, spine: DataFrame | None, max_len: int, arrays: list[str],
            batch_col: str = "batch_id", ord_col: str = "ord", pads: dict | None = None) -> DataFrame:
    """Q10/Q11: per batch, concatenate members' arrays in batch order (failed
    members -- NULL arrays -- are dropped), cut/pad to ``max_len``, and
    record ``lengths``.  Batches of the ``spine`` without members become one
    all-padding sample.  A batch holds at most ``max_len`` tokens by
    construction (packing), so the per-batch ``collect_list`` is bounded."""
    pads = pads or {}
    ok = members.filter(F.col(arrays[0]).isNotNull())
    g = ok.groupBy(batch_col).agg(F.sort_array(F.collect_list(F.struct(ord_col, *arrays))).alias("_m"))
    if spine is not None:
        g = spine.select(batch_col).distinct().join(g, batch_col, "left")
    cols = [batch_col]

    def field(name):
        return lambda x: x[name]
    for a in arrays:
        flat = F.coalesce(F.flatten(F.transform("_m", field(a))), F.array())
        cols.append(pad_or_cut(flat, max_len, pads.get(a, 0)).alias(a))
    lengths = F.coalesce(F.transform("_m", lambda x: F.size(x[arrays[0]])), F.array().cast("array<int>"))
    cols.append(lengths.alias("raw_lengths"))
    return g.select(*cols)


def kept_lengths(df: DataFrame, max_len: int, batch_col: str = "batch_id", ord_col: str = "ord",
                 len_col: str = "len") -> DataFrame:
    """Q12: running sum inside a batch; members starting at or after
    ``max_len`` vanish, the one crossing it is cut to ``max_len - prev``.
    (A batch is bounded by the packing capacity.)"""
    w = Window.partitionBy(batch_col).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_prev", F.coalesce(F.sum(len_col).over(w), F.lit(0)))
    return (d.filter(F.col("_prev") < max_len)
             .withColumn("kept_len", F.least(F.col(len_col), F.lit(max_len) - F.col("_prev")).cast("int"))
             .drop("_prev"))


def document_ids(lengths: Column, max_len: int) -> Column:
    """Q13: position -> index of the document it belongs to inside a pack;
    padding positions get -1; lengths summing past ``max_len`` fail."""
    ids = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    chk = F.assert_true(total <= max_len, F.lit("lengths exceed max_len"))
    return F.when(chk.isNull(), pad_or_cut(ids, max_len, -1))


# ------------------------------------------------------------------ Q14 - Q16
def off_policy_inputs(ids: Column, k: int) -> Column:
    """Q14: inputs for step ``k``: shift left by ``k + 1``, zero fill."""
    return shift_left(ids, k + 1, 0)


def mtp_steps(tokens: DataFrame, num_steps: int, key: str = "sample_idx") -> DataFrame:
    """Q15: long-form MTP step table from ``(key, pos, token, mask)``: for
    step ``k`` the input token at ``t+k+1``, the target at ``t+k+2``
    (``-100`` where masked out); valid ``t < n-k-2``; steps stop when that
    length is <= 0.  Windows per sample (bounded by the sequence length)."""
    w = Window.partitionBy(key).orderBy("pos")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    base = tokens.withColumn("_n", n)
    out = None
    for k in range(num_steps):
        s = base.select(
            key, "pos", F.lit(k).alias("step"), "_n",
            F.lead("token", k + 1).over(w).alias("input_token"),
            F.lead("token", k + 2).over(w).alias("_t"),
            F.lead("mask", k + 2).over(w).alias("_m"))
        s = s.filter(F.col("pos") < F.col("_n") - (k + 2)).select(
            key, "pos", "step", "input_token",
            F.when(F.col("_m"), F.col("_t")).otherwise(F.lit(IGNORE_INDEX)).alias("target"))
        out = s if out is None else out.unionByName(s)
    return out


def step_alignment(df: DataFrame, k: int, key: str = "sample_idx") -> DataFrame:
    """Q16: predictions at ``t`` against ``target[t+k]``/``mask[t+k]``; the
    tail without a partner is dropped."""
    w = Window.partitionBy(key).orderBy("pos")
    return (df.withColumn("target_k", F.lead("target", k).over(w))
              .withColumn("mask_k", F.lead("mask", k).over(w))
              .filter(F.col("target_k").isNotNull()))


# ------------------------------------------------------------------ Q17 - Q21
def select_anchors(tokens: DataFrame, num_anchors: int, block_size: int, seed: int,
                   key: str = "sample_idx") -> DataFrame:
    """Q17: up to ``num_anchors`` random trainable positions per pack,
    excluding the last ``block_size`` positions; short packs are padded with
    ``(anchor 0, valid false)``.  Output ``(key, slot, anchor, valid)``.

    Random choice = the ``num_anchors`` smallest keyed draws per pack
    (window bounded by the pack length); slots are filled in draw order.
    """
    if block_size <= 0:
        raise ValueError("block size must be > 0")
    n = F.max("pos").over(Window.partitionBy(key)) + 1
    cand = tokens.withColumn("_n", n).filter(F.col("mask") & (F.col("pos") < F.col("_n") - block_size))
    w = Window.partitionBy(key).orderBy(order_key(seed, key, "pos"), "pos")
    picked = cand.withColumn("slot", F.row_number().over(w) - 1).filter(F.col("slot") < num_anchors)
    spine = tokens.select(key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(num_anchors - 1))))
    return (spine.join(picked.select(key, "slot", F.col("pos").alias("anchor")), [key, "slot"], "left")
                 .select(key, "slot", F.coalesce("anchor", F.lit(0)).cast("int").alias("anchor"),
                         F.col("anchor").isNotNull().alias("valid")))


def block_positions(anchors: DataFrame, block_size: int, total_len: Column | None = None) -> DataFrame:
    """Q18: ``anchor + 0..b-1`` per anchor; a position outside
    ``[0, total_len)`` fails the job."""
    d = anchors.select("*", F.posexplode(F.sequence(F.col("anchor"), F.col("anchor") + block_size - 1)).alias("offset", "position"))
    bad = F.col("position") < 0
    if total_len is not None:
        bad = bad | (F.col("position") >= total_len)
    return d.withColumn("position", F.when(bad, F.raise_error(F.lit("anchor block out of range")).cast("int"))
                        .otherwise(F.col("position")))


def block_targets(blocks: DataFrame, tokens: DataFrame, mask_token_id: int, key: str = "sample_idx") -> DataFrame:
    """Q19-Q21: for each block position: the loss mask (base mask, 0 for
    padded anchors and at offset 0), the input (mask token except the
    anchor's own token) and the target rolled right by one (wrapping at 0:
    position p takes the token of ``(p - 1) mod n``)."""
    n = tokens.groupBy(key).agg((F.max("pos") + 1).alias("_n"))
    b = blocks.join(n, key)
    base = tokens.select(key, F.col("pos").alias("position"), F.col("token").alias("_tok"), F.col("mask").alias("_m"))
    prev = tokens.select(key, F.col("pos").alias("_pp"), F.col("token").alias("target"))
    j = (b.join(base, [key, "position"], "left")
          .join(prev, (b[key] == prev[key]) & (F.pmod(b["position"] - 1, b["_n"]) == prev["_pp"]), "left")
          .drop(prev[key]))
    return j.select(
        key, "slot", "offset", "position",
        F.when((F.col("offset") == 0) | ~F.col("valid"), F.lit(0)).otherwise(F.col("_m").cast("int")).alias("block_mask"),
        F.when(F.col("offset") == 0, F.col("_tok")).otherwise(F.lit(mask_token_id)).alias("block_input"),
        "target")


# ------------------------------------------------------------------ Q22 / Q23
def cod_sample(tokens: DataFrame, num_depths: int, ratio: float, ratio_min: float, seed: int,
               key: str = "sample_idx", filter_position_zero: bool = True) -> DataFrame:
    """Q22: COD sampling, unrolled over depths.

    Depth 0 keeps every position.  Depth ``d`` draws
    ``int(max(0, V - d) * max(ratio^d, ratio_min))`` positions of the
    current pool (the whole pool when smaller), ``V`` = trainable count;
    the next pool is ``(chosen + 1) mod n``, without 0 if filtered, still
    trainable.  Emits ``(key, anchor = chosen - d, depth)``.  Each depth is
    a window rank of keyed draws plus a semi join (bounded per sample).
    """
    stats = tokens.groupBy(key).agg((F.max("pos") + 1).alias("_n"), F.count_if("mask").alias("_v"))
    valid = tokens.filter("mask").select(key, "pos")
    out = [tokens.select(key, F.col("pos").alias("anchor"), F.lit(0).alias("depth"))]
    pool = valid
    for d in range(1, num_depths):
        size = F.floor(F.greatest(F.col("_v") - d, F.lit(0)) * F.lit(max(ratio ** d, ratio_min))).cast("int")
        p = pool.join(stats, key).withColumn("_size", size).filter(F.col("_size") > 0)
        w = Window.partitionBy(key).orderBy(order_key(seed, key, F.lit(d), "pos"), "pos")
        chosen = (p.withColumn("_r", F.row_number().over(w))
                   .withColumn("_pn", F.count(F.lit(1)).over(Window.partitionBy(key)))
                   .filter((F.col("_r") <= F.col("_size")) | (F.col("_pn") < F.col("_size")))
                   .select(key, "pos", "_n"))
        out.append(chosen.select(key, (F.col("pos") - d).alias("anchor"), F.lit(d).alias("depth")))
        nxt = chosen.select(key, F.pmod(F.col("pos") + 1, F.col("_n")).alias("pos"))
        if filter_position_zero:
            nxt = nxt.filter(F.col("pos") != 0)
        pool = nxt.join(valid, [key, "pos"], "left_semi")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def cod_inputs(samples: DataFrame, tokens: DataFrame, mask_token_id: int, key: str = "sample_idx") -> DataFrame:
    """Q23: original position = anchor + depth; the real token at depth 0,
    the mask token otherwise; the loss mask gathered at that position."""
    s = samples.withColumn("position", F.col("anchor") + F.col("depth"))
    t = tokens.select(key, F.col("pos").alias("position"), "token", "mask")
    j = s.join(t, [key, "position"], "left")
    return j.select(key, "anchor", "depth", "position",
                    F.when(F.col("depth") == 0, F.col("token")).otherwise(F.lit(mask_token_id)).alias("input_token"),
                    F.coalesce(F.col("mask"), F.lit(False)).alias("mask"))


ARRAY_INT = T.ArrayType(T.IntegerType())


# ====================================================================
# Array forms.  A prepared sample is one row whose arrays are bounded by
# the maximum sequence length, so the per-sample operators below are narrow
# transformations (no shuffle): positions come from ``sequence``, lookups
# from ``element_at``, random choices from sorting keyed md5 draws inside
# the row.  Outputs are long form via ``inline``.
# ====================================================================
def _key_hash(seed, key: Column, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), *[p.cast("string") for p in parts]))


def mtp_steps_arrays(samples: DataFrame, num_steps: int, key: str = "sample_idx", ids: str = "input_ids",
                     mask: str = "loss_mask") -> DataFrame:
    """Q15 on sample arrays: for step ``k`` and ``t < n - k - 2`` the input
    token at ``t+k+1`` and the target at ``t+k+2`` (``-100`` where masked
    out)."""
    a, m = F.col(ids), F.col(mask).cast("array<boolean>")

    def step(k):
        def f(t):
            return F.struct(t.cast("long").alias("pos"), F.lit(k).alias("step"),
                            F.element_at(a, t + (k + 2)).alias("input_token"),
                            F.when(F.element_at(m, t + (k + 3)), F.element_at(a, t + (k + 3)))
                             .otherwise(F.lit(IGNORE_INDEX)).alias("target"))
        return f
    rows = F.concat(*[F.transform(positions(F.size(a) - (k + 2)), step(k)) for k in range(num_steps)])
    return samples.select(key, F.inline(rows))


def step_alignment_arrays(samples: DataFrame, k: int, key: str = "sample_idx", target: str = "input_ids",
                          mask: str = "loss_mask") -> DataFrame:
    """Q16 on sample arrays: position ``t`` against ``target[t+k]`` and
    ``mask[t+k]``; positions without a partner are dropped."""
    a, m = F.col(target), F.col(mask)
    rows = F.transform(positions(F.size(a) - k), lambda t: F.struct(
        t.cast("long").alias("pos"), F.element_at(a, t + (k + 1)).alias("target_k"),
        F.element_at(m, t + (k + 1)).alias("mask_k")))
    return samples.select(key, F.inline(rows))


def anchors_arrays(samples: DataFrame, num_anchors: int, block_size: int, seed: int,
                   key: str = "sample_idx", mask: str = "loss_mask") -> DataFrame:
    """Q17 on sample arrays: adds ``anchors`` = ``num_anchors`` slots
    ``struct(slot, anchor, valid)``: trainable positions outside the last
    ``block_size`` positions, chosen by smallest keyed draw; missing slots
    are ``(0, false)``."""
    if block_size <= 0:
        raise ValueError("block size must be > 0")
    m = F.col(mask).cast("array<boolean>")
    k = F.col(key)
    cand = F.filter(positions(F.size(m) - block_size), lambda p: F.element_at(m, p + 1))
    keyed = F.transform(cand, lambda p: F.struct(_key_hash(seed, k, p).alias("h"), p.alias("p")))
    d = samples.withColumn("_picked", F.transform(F.slice(F.array_sort(keyed), 1, num_anchors), lambda x: x["p"]))
    slots = F.transform(F.sequence(F.lit(0), F.lit(num_anchors - 1)), lambda i: F.struct(
        i.alias("slot"), F.coalesce(F.try_element_at(F.col("_picked"), i + 1), F.lit(0)).alias("anchor"),
        (i < F.size("_picked")).alias("valid")))
    return d.withColumn("anchors", slots).drop("_picked")


def block_targets_arrays(with_anchors: DataFrame, block_size: int, mask_token_id: int, key: str = "sample_idx",
                         ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """Q18-Q21 on sample arrays: block positions ``anchor + 0..b-1`` (out of
    range fails the job), block loss mask (base mask, 0 for padded anchors
    and at offset 0), block inputs (mask token except the anchor's own
    token) and targets rolled right by one with wrap-around."""
    a, m = F.col(ids), F.col(mask).cast("array<boolean>")
    n = F.size(a)

    def per_anchor(s):
        def per_offset(o):
            pos = s["anchor"] + o
            bad = (pos < 0) | (pos >= n)
            pos_chk = F.when(bad, F.raise_error(F.lit("anchor block out of range")).cast("int")).otherwise(pos)
            return F.struct(
                s["slot"].alias("slot"), o.alias("offset"), pos_chk.alias("position"),
                F.when((o == 0) | ~s["valid"], F.lit(0)).otherwise(F.element_at(m, pos_chk + 1).cast("int")).alias("block_mask"),
                F.when(o == 0, F.element_at(a, pos_chk + 1)).otherwise(F.lit(mask_token_id)).alias("block_input"),
                F.element_at(a, F.pmod(pos_chk - 1, n) + 1).alias("target"))
        return F.transform(F.sequence(F.lit(0), F.lit(block_size - 1)), per_offset)
    rows = F.flatten(F.transform(F.col("anchors"), per_anchor))
    return with_anchors.select(key, F.inline(rows))


def cod_sample_arrays(samples: DataFrame, num_depths: int, ratio: float, ratio_min: float, seed: int,
                      key: str = "sample_idx", ids: str = "input_ids", mask: str = "loss_mask",
                      mask_token_id: int | None = None, filter_position_zero: bool = True) -> DataFrame:
    """Q22 (+ Q23 with ``mask_token_id``) on sample arrays.

    Depth 0 keeps every position; depth ``d`` keeps
    ``int(max(0, V - d) * max(ratio^d, ratio_min))`` positions of the pool
    (smallest keyed draws; the whole pool when smaller), V = trainable
    count; the next pool is ``(chosen + 1) mod n`` (without 0 if filtered)
    restricted to trainable positions.  One ``withColumn`` per depth keeps
    each depth's pool materialised inside the row.  Output rows
    ``(key, anchor, depth[, position, input_token, mask])``.
    """
    a, m = F.col(ids), F.col(mask).cast("array<boolean>")
    k = F.col(key)
    n = F.size(a)
    d = samples.withColumn("_v", F.filter(positions(n), lambda p: F.element_at(m, p + 1)))
    d = d.withColumn("_pool", F.col("_v"))
    outs = ["_o0"]
    d = d.withColumn("_o0", F.transform(positions(n), lambda p: F.struct(p.alias("anchor"), F.lit(0).alias("depth"))))
    for depth in range(1, num_depths):
        size = F.floor(F.greatest(F.size("_v") - depth, F.lit(0)) * F.lit(float(max(ratio ** depth, ratio_min)))).cast("int")
        keyed = F.transform(F.col("_pool"), _cod_key(seed, k, F.lit(depth)))
        picked = F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, F.greatest(size, F.lit(0))), lambda x: x["p"]))
        chosen = (F.when(size <= 0, F.array().cast("array<int>"))
                   .when(F.size("_pool") >= size, picked).otherwise(F.col("_pool")))
        d = d.withColumn("_c", chosen)
        d = d.withColumn(f"_o{depth}", F.transform(F.col("_c"), _cod_out(depth)))
        outs.append(f"_o{depth}")
        nxt = F.transform(F.col("_c"), lambda p: F.pmod(p + 1, n))
        keep = (lambda p: (p != 0) & F.element_at(m, p + 1)) if filter_position_zero else (lambda p: F.element_at(m, p + 1))
        d = d.withColumn("_pool", F.filter(nxt, keep)).drop("_c")
    rows = F.concat(*[F.col(o) for o in outs])
    if mask_token_id is not None:
        rows = F.transform(rows, lambda r: F.struct(
            r["anchor"].alias("anchor"), r["depth"].alias("depth"), (r["anchor"] + r["depth"]).alias("position"),
            F.when(r["depth"] == 0, F.try_element_at(a, r["anchor"] + 1)).otherwise(F.lit(mask_token_id)).alias("input_token"),
            F.coalesce(F.try_element_at(m, r["anchor"] + r["depth"] + 1), F.lit(False)).alias("mask")))
    return d.select(key, F.inline(rows))


def _cod_key(seed, k, dl):
    return lambda p: F.struct(_key_hash(seed, k, dl, p).alias("h"), p.alias("p"))


def _cod_out(depth):
    return lambda p: F.struct((p - depth).alias("anchor"), F.lit(depth).alias("depth"))


# Per-sample preprocessing before collate, by draft type (a plain
# registry of DataFrame -> DataFrame functions; use with ``df.transform``).
PREPROCESS = {
    "next_token": next_token_shift,   # shifted next-token drafts
    "multi_token": mtp_view,          # multi-token prediction heads
    "block": lambda df: df,           # block drafts (anchors applied later, Q17-Q21)
    "parallel": next_token_shift,     # parallel-depth drafts (shifted like next_token, then Q22-Q23)
}
