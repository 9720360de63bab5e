"""Rendering, tokenising and loss masks.

Chat templates are declarative: a BOS string plus a prefix and a suffix per
role.  Rendering, tokenising and masking are then plain column expressions on
long-form turn rows:

* tokens of a turn = tokens(prefix) ++ tokens(content) ++ tokens(suffix) --
  prefix/suffix tokens are literals computed once on the driver;
* mask of a turn   = content tokens of assistant turns (the regex group of
  the template's assistant pattern covers exactly the content);
* a turn's first token position = salted running sum of token counts over
  the earlier turns of its conversation; truncation at ``max_length`` is a
  filter + ``slice`` *before* anything is collected per sample.

Template boundaries are checked so that tokenising per turn equals
tokenising the whole rendered text: every prefix must end and every suffix
must start with a character that cannot extend a word token.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex as _re
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit.functions.index import dense_index, running_sum
from draftkit.functions.joins import checked_broadcast_join, measured_bytes
from draftkit.functions.text import TOKEN_PATTERN, tokenize, tokenize_local
from draftkit.session import materialize, small_batches

_WORD = _re.compile(r"[\p{L}\p{N}]")
BOS_ORD = -(2 ** 62)


@dataclass(frozen=True)
class ChatTemplate:
    """Declarative chat template: ``bos`` + per role ``prefix + content + suffix``."""
    name: str
    bos: str
    prefix: dict = field(default_factory=dict)
    suffix: dict = field(default_factory=dict)
    provides_mask: bool = True

    def __post_init__(self):
        for r, p in self.prefix.items():
            if p and _WORD.match(p[-1]):
                raise ValueError(f"template {self.name}: prefix of {r} ends inside a word")
        for r, s in self.suffix.items():
            if s and _WORD.match(s[0]):
                raise ValueError(f"template {self.name}: suffix of {r} starts inside a word")
        if self.bos and _WORD.match(self.bos[-1]):
            raise ValueError(f"template {self.name}: bos ends inside a word")

    def render_local(self, turns: list[dict]) -> str:
        """Rendering of a few literal turns on the driver (tests)."""
        return self.bos + "".join(self.prefix[t["role"]] + t["content"] + self.suffix[t["role"]] for t in turns)


def _roles(fmt_prefix, fmt_suffix):
    rs = ("system", "user", "assistant", "tool")
    return {r: fmt_prefix.format(role=r) for r in rs}, {r: fmt_suffix.format(role=r) for r in rs}


# Public chat-template formats.
_CHATML = _roles("<|im_start|>{role}\n", "<|im_end|>\n")
_LLAMA3 = _roles("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>")
_GEMMA = ({"system": "<start_of_turn>system\n", "user": "<start_of_turn>user\n",
           "assistant": "<start_of_turn>model\n", "tool": "<start_of_turn>tool\n"},
          {r: "<end_of_turn>\n" for r in ("system", "user", "assistant", "tool")})
_PLAIN = ({"system": "System: ", "user": "User: ", "assistant": "Assistant: ", "tool": "Tool: "},
          {r: "\n" for r in ("system", "user", "assistant", "tool")})
_MISTRAL = ({"system": "[SYSTEM_PROMPT] ", "user": "[INST] ", "assistant": " ", "tool": "[TOOL_RESULTS] "},
            {"system": " [/SYSTEM_PROMPT]", "user": " [/INST]", "assistant": "</s>", "tool": " [/TOOL_RESULTS]"})
_PHI3 = _roles("<|{role}|>\n", "<|end|>\n")
_HARMONY = ({"system": "<|start|>system<|message|>", "user": "<|start|>user<|message|>",
             "assistant": "<|start|>assistant<|channel|>final<|message|>", "tool": "<|start|>tool<|message|>"},
            {r: "<|end|>" for r in ("system", "user", "assistant", "tool")})
TEMPLATES = {
    "chatml": ChatTemplate("chatml", "", *_CHATML),
    "llama3": ChatTemplate("llama3", "<|begin_of_text|>", *_LLAMA3),
    "gemma": ChatTemplate("gemma", "<bos>", *_GEMMA),
    "plain": ChatTemplate("plain", "", *_PLAIN),
    "mistral": ChatTemplate("mistral", "<s>", *_MISTRAL),
    "phi3": ChatTemplate("phi3", "", *_PHI3),
    "harmony": ChatTemplate("harmony", "", *_HARMONY),
}


def _by_role(role: Column, values: dict, default) -> Column:
    expr = None
    for r, v in values.items():
        expr = F.when(role == r, v) if expr is None else expr.when(role == r, v)
    return expr.otherwise(default) if expr is not None else default


def _str_array(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


# ---------------------------------------------------------------- T1 render
def render_pieces(turns: DataFrame, template: ChatTemplate, key_col: str = "conv_id",
                  turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One rendered piece per turn plus one BOS piece per conversation.

    Output: ``key, ord, role, piece, content_start, content_end, char_start``
    where ``char_start`` is the piece's offset in the whole rendered text and
    ``content_*`` delimit the content inside the piece.
    """
    role = F.col(role_col)
    pre = _by_role(role, {r: F.lit(p) for r, p in template.prefix.items()}, F.lit(""))
    suf = _by_role(role, {r: F.lit(s) for r, s in template.suffix.items()}, F.lit(""))
    body = turns.select(
        F.col(key_col), F.col(turn_col).cast("long").alias("ord"), role.alias("role"),
        F.concat(pre, F.coalesce(F.col(text_col), F.lit("")), suf).alias("piece"),
        F.length(pre).alias("content_start"),
        (F.length(pre) + F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("content_end"))
    parts = body
    if template.bos:
        bos = (turns.select(key_col).distinct()
               .select(F.col(key_col), F.lit(BOS_ORD).cast("long").alias("ord"), F.lit("bos").alias("role"),
                       F.lit(template.bos).alias("piece"), F.lit(0).alias("content_start"),
                       F.lit(0).alias("content_end")))
        parts = bos.unionByName(body)
    return running_sum(parts, [key_col], "ord", F.length("piece"), "char_start")


# ------------------------------------------------------- T4/T7 tokens + mask
def turn_tokens(turns: DataFrame, template: ChatTemplate, key_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """T4 (regex tokenizer, JVM-side) + T7 (template-provided mask) per turn.

    Output: ``key, ord, role, tokens array<string>, mask array<boolean>, n_tok``.
    """
    role = F.col(role_col)
    pre = _by_role(role, {r: _str_array(tokenize_local(p)) for r, p in template.prefix.items()},
                   F.array().cast("array<string>"))
    suf = _by_role(role, {r: _str_array(tokenize_local(s)) for r, s in template.suffix.items()},
                   F.array().cast("array<string>"))
    body_tok = tokenize(F.col(text_col))
    d = turns.select(F.col(key_col), F.col(turn_col).cast("long").alias("ord"), role.alias("role"),
                     pre.alias("_p"), body_tok.alias("_b"), suf.alias("_s"))
    d = d.select(key_col, "ord", "role",
                 F.concat("_p", "_b", "_s").alias("tokens"),
                 F.concat(F.array_repeat(F.lit(False), F.size("_p")),
                          F.array_repeat(F.col("role") == "assistant", F.size("_b")),
                          F.array_repeat(F.lit(False), F.size("_s"))).alias("mask"))
    if template.bos:
        bos_tok = tokenize_local(template.bos)
        bos = (turns.select(key_col).distinct()
               .select(F.col(key_col), F.lit(BOS_ORD).cast("long").alias("ord"), F.lit("bos").alias("role"),
                       _str_array(bos_tok).alias("tokens"),
                       F.array_repeat(F.lit(False), len(bos_tok)).alias("mask")))
        d = bos.unionByName(d)
    return d.withColumn("n_tok", F.size("tokens"))


def truncate_turns(tok: DataFrame, max_length: int, key_col: str = "conv_id") -> DataFrame:
    """T4 truncation: first token position of each turn (``start``) from a
    salted running sum; turns starting at or after ``max_length`` vanish and
    the last kept turn is cut (both ``tokens`` and ``mask``)."""
    d = running_sum(tok, [key_col], "ord", "n_tok", "start")
    d = d.filter(F.col("start") < max_length)
    keep = F.least(F.col("n_tok"), F.lit(max_length) - F.col("start")).cast("int")
    return (d.withColumn("tokens", F.slice("tokens", 1, keep))
             .withColumn("mask", F.slice("mask", 1, keep))
             .withColumn("n_tok", F.size("tokens")))


def cut_long(tok: DataFrame, max_length: int, key_col: str = "conv_id") -> DataFrame:
    """T4 truncation without positions: conversations within ``max_length``
    pass as they are, in place; only turns of longer ones meet their first
    positions, found on narrow ``(key, ord, n_tok)`` rows.  Where none is
    longer there is nothing to join.  ``tok`` is read several times, so it
    should be a written table."""
    sizes = tok.select(key_col, "ord", "n_tok")
    long = sizes.groupBy(key_col).agg(F.sum("n_tok").alias("_all")).filter(F.col("_all") > max_length).select(key_col)
    long = materialize(long, "long-samples")
    if long.isEmpty():
        return tok
    starts = running_sum(checked_broadcast_join(sizes, long, key_col, "left_semi"), [key_col], "ord", "n_tok", "_start")
    starts = materialize(starts.select(key_col, "ord", "_start"), "turn-starts")
    # a turn of a short conversation has no start: it is whole
    d = checked_broadcast_join(tok, starts, [key_col, "ord"], "left")
    keep = F.least(F.col("n_tok"), F.greatest(F.lit(max_length) - F.coalesce("_start", F.lit(0)), F.lit(0))).cast("int")
    keep = F.when(F.col("_start").isNull(), F.col("n_tok")).otherwise(keep)
    return (d.withColumn("_keep", keep).filter(F.col("_keep") > 0)
             .withColumn("tokens", F.slice("tokens", 1, F.col("_keep"))).withColumn("mask", F.slice("mask", 1, F.col("_keep")))
             .withColumn("n_tok", F.col("_keep")).drop("_keep", "_start"))


def token_rows(cut: DataFrame) -> DataFrame:
    """``(token, trainable)`` of turns, without positions."""
    return cut.select(F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("mask").alias("trainable"))))


def assembled(cut: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """One row per sample with its tokens and mask (the turns were cut
    before, so a sample holds at most ``max_length`` of them)."""
    g = cut.groupBy(key_col).agg(F.sort_array(F.collect_list(F.struct("ord", "tokens", "mask"))).alias("_t"))
    return g.select(key_col, F.flatten("_t.tokens").alias("tokens"), F.flatten("_t.mask").alias("loss_mask"))


def token_positions(trunc: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """Long form of truncated turns: one row per token with its sample
    position (no shuffle: a ``posexplode`` per turn row)."""
    return (trunc.select(key_col, "ord", "start",
                         F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("mask").alias("m")))
                         .alias("i", "z"))
                 .select(key_col, (F.col("start") + F.col("i")).alias("pos"),
                         F.col("z.token").alias("token"), F.col("z.m").alias("trainable")))


# ----------------------------------------------------- T13 vocabulary ids
def build_vocabulary(token_rows: DataFrame, token_col: str = "token", extra_aggs=()) -> DataFrame:
    """``(token, token_id, n, ...)``; ids by descending count, then token.

    The count is a partial+final hash aggregate (hot tokens are combined
    map-side); ids come from the distributed dense index, not from a
    single-task window.  ``extra_aggs`` are computed in the same pass (and
    kept in the written vocabulary table), e.g. trainable-token counts.
    """
    counts = token_rows.groupBy(token_col).agg(F.count(F.lit(1)).alias("n"), *extra_aggs)
    return dense_index(counts, [F.col("n").desc(), F.col(token_col)], "token_id").withColumn(
        "token_id", F.col("token_id").cast("int"))


def hot_tokens(vocab: DataFrame, max_bytes: int, token_col: str = "token") -> tuple[DataFrame, int | None]:
    """The most frequent tokens (the lowest ids) whose ``(token, token_id)``
    rows measure at most ``max_bytes``, and their number (None for all)."""
    pairs = vocab.select(token_col, "token_id")
    size, n = measured_bytes(pairs), None
    while size > max_bytes:
        n = pairs.count() if n is None else n
        n = int(n * max_bytes / size * 0.9)
        pairs = vocab.filter(F.col("token_id") < n).select(token_col, "token_id")
        size = measured_bytes(pairs)
    return pairs, n


def with_token_ids(samples: DataFrame, vocab: DataFrame, max_bytes: int, key_col: str = "conv_id") -> DataFrame:
    """T13 ids of whole samples: ``(key, tokens, loss_mask)``, one row a
    sample and dealt out by the key, -> ``(key, input_ids, loss_mask)``.

    The most frequent tokens, as many as fit ``max_bytes``, are a broadcast
    dictionary and settle in place.  Of the others a sample sends each
    distinct token once, with the list of its positions, through one hash
    join with the vocabulary; being rare, no one of them makes a hot key."""
    ex = samples.select(key_col, F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("loss_mask").alias("m"))).alias("pos", "z"))
    ex = ex.select(key_col, "pos", F.col("z.token").alias("token"), F.col("z.m").alias("trainable"))
    hot, n_hot = hot_tokens(vocab, max_bytes)
    if n_hot is None:
        g = ex.join(F.broadcast(hot), "token").groupBy(key_col).agg(F.sort_array(F.collect_list(F.struct("pos", "token_id", "trainable"))).alias("_t"))
        return g.select(key_col, F.col("_t.token_id").alias("input_ids"), F.col("_t.trainable").alias("loss_mask"))
    near = ex.join(F.broadcast(hot), "token", "left")
    # within the partitions of the samples: a token's positions, then a sample's tokens
    by_token = near.groupBy(key_col, "token", "token_id").agg(F.collect_list(F.struct("pos", "trainable")).alias("at"))
    group = F.struct(F.when(F.col("token_id").isNull(), F.col("token")).alias("token"), "token_id", "at")
    held = materialize(by_token.groupBy(key_col).agg(F.collect_list(group).alias("_g")), "sample-tokens")
    rare = held.select(key_col, F.inline(F.filter("_g", lambda g: g["token_id"].isNull()))).select(key_col, "token", "at")
    rest = vocab.filter(F.col("token_id") >= n_hot).select("token", "token_id")
    found = rare.join(rest.hint("shuffle_hash"), "token").groupBy(key_col).agg(F.collect_list(F.struct("token_id", "at")).alias("_r"))
    none = F.array().cast("array<struct<token_id:int,at:array<struct<pos:int,trainable:boolean>>>>")
    known = F.transform(F.filter("_g", lambda g: g["token_id"].isNotNull()), lambda g: F.struct(g["token_id"].alias("token_id"), g["at"].alias("at")))
    every = F.concat(known, F.coalesce("_r", none))
    flat = F.flatten(F.transform(every, lambda g: F.transform(g["at"], lambda a: F.struct(
        a["pos"].alias("pos"), g["token_id"].alias("token_id"), a["trainable"].alias("trainable")))))
    out = held.join(found, key_col, "left").select(key_col, F.sort_array(flat).alias("_t"))
    return out.select(key_col, F.col("_t.token_id").alias("input_ids"), F.col("_t.trainable").alias("loss_mask"))


# ------------------------------------------------------------ T2 / T3
def assistant_pattern(template: ChatTemplate) -> str:
    """The regex of assistant spans, straight from the template's own
    fields: what opens an assistant turn, its content as the group, and what
    ends it.  A template that opens assistant turns with blanks only opens
    them with the end of the user's turn.  The content may not run over the
    opening of another turn; a template that ends assistant turns with nothing
    ends them where another turn opens, or with the text."""
    opens = sorted({p for p in template.prefix.values() if p.strip()}, key=lambda p: (-len(p), p))
    head = template.prefix.get("assistant", "")
    if not head.strip():
        head = template.suffix.get("user", "") + head
    if not head.strip() or not opens:
        raise ValueError(f"template {template.name}: nothing opens an assistant turn")
    other = "|".join(_re.escape(p, literal_spaces=True) for p in opens)
    close = template.suffix.get("assistant", "")
    end = _re.escape(close, literal_spaces=True) if close else rf"(?={other}|\Z)"
    return _re.escape(head, literal_spaces=True) + f"((?:(?!{other}).)*?)" + end


def choose_mask_source(custom_pattern: str | None, template: ChatTemplate) -> tuple[str, str | None]:
    """Custom pattern > template-provided mask > the template's own pattern."""
    if custom_pattern:
        return "pattern", custom_pattern
    if template.provides_mask:
        return "template", None
    return "pattern", assistant_pattern(template)


# ------------------------------------------------------------ T5 / T6
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                 T.StructField("end", T.IntegerType())]))


def _ints(values: array) -> pa.Array:
    return pa.array(np.frombuffer(values, np.int32) if len(values) else np.empty(0, np.int32))


def span_lists(rows: Iterable[Iterable[tuple[int, int]]]) -> pa.ListArray:
    """SPAN values from every row's (start, end) pairs: eight bytes a span,
    where a list of dicts takes hundreds."""
    ends, pairs = array("i", [0]), array("i")
    for row in rows:
        for pair in row:
            pairs.extend(pair)
        ends.append(len(pairs) // 2)
    both = np.frombuffer(pairs, np.int32).reshape(-1, 2) if len(pairs) else np.empty((0, 2), np.int32)
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["start", "end"])
    return pa.ListArray.from_arrays(_ints(ends), spans)


def _matches(texts: pa.Array, rx, group: int) -> Iterator[Iterator[tuple[int, int]]]:
    """Each text's matches, one text at a time as a Python string."""
    return ((m.span(group) for m in rx.finditer(t.as_py() or "")) for t in texts)


def assistant_spans(text: Column, pattern: str) -> Column:
    """T5: character spans of group 1 of every (leftmost, non-overlapping,
    DOTALL) match.  Spark has no match positions, so this is an Arrow UDF
    over small batches (one regex scan per row, no shuffle)."""
    rx = _re.compile(pattern, _re.DOTALL)
    small_batches(SparkSession.active())

    @F.arrow_udf(SPAN)
    def _spans(s: pa.Array) -> pa.Array:
        return span_lists(_matches(s, rx, 1))
    return _spans(text)


# ------------------------------------------------------------ T4 (b)
ENCODING = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                         T.StructField("offsets", SPAN)])
_TOKENIZERS: dict = {}
#: Texts that a tokenizer encodes at a time (its encodings are large).
ENCODE_ROWS = 32


def _load_tokenizer(path: str):
    tok = _TOKENIZERS.get(path)
    if tok is None:
        from tokenizers import Tokenizer  # installed; loaded once per Python worker
        tok = _TOKENIZERS[path] = Tokenizer.from_file(path)
    return tok


def encode_with_tokenizer(text: Column, tokenizer_path: str, max_length: int | None = None) -> Column:
    """T4 (b): ids and character offsets from a ``tokenizers`` JSON file
    (no special tokens, truncated at ``max_length``).  Arrow-batched: a few
    texts at a time are encoded with ``encode_batch``; the file must be readable by
    every executor (shared folder or ``SparkContext.addFile``)."""
    small_batches(SparkSession.active())

    @F.arrow_udf(ENCODING)
    def _enc(s: pa.Array) -> pa.Array:
        tok = _load_tokenizer(tokenizer_path)
        ids, ends, offs = array("i"), array("i", [0]), []
        for a in range(0, len(s), ENCODE_ROWS):
            encs = tok.encode_batch([t or "" for t in s.slice(a, ENCODE_ROWS).to_pylist()], add_special_tokens=False)
            for e in encs:
                ids.extend(e.ids[:max_length])
                ends.append(len(ids))
            offs.append(span_lists(e.offsets[:max_length] for e in encs))
        offs = pa.concat_arrays(offs) if offs else span_lists([])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(_ints(ends), _ints(ids)), offs], ["ids", "offsets"])
    return _enc(text)


def token_offsets(text: Column) -> Column:
    """Character offsets of the regex tokens (Arrow UDF, one scan per row)."""
    rx = _re.compile(TOKEN_PATTERN)
    small_batches(SparkSession.active())

    @F.arrow_udf(SPAN)
    def _offs(s: pa.Array) -> pa.Array:
        return span_lists(_matches(s, rx, 0))
    return _offs(text)


def overlap_mask(offsets: Column, spans: Column) -> Column:
    """Token trainable iff it overlaps a span (``end > s AND start < e``).
    ``spans`` must be a plain column (materialise UDF results first, see
    ``with_assistant_mask``)."""
    return F.transform(offsets, lambda o: F.exists(spans, lambda s: (o["end"] > s["start"]) & (o["start"] < s["end"])))


def overlap_mask_sweep(df: DataFrame, key_cols: list[str], offsets_col: str, spans_col: str, out: str) -> DataFrame:
    """T6 as an interval join by sweep: token ends and span starts of a row
    become marks in text order; a running maximum says how far the spans
    begun so far reach, and a token is trainable iff that is beyond its start
    (spans may overlap; those that begin at or after a token's end come after
    it).  Linear in tokens and spans but for their sorting, where
    ``overlap_mask`` looks at all spans for every token.  ``key_cols`` tell
    the rows of ``df`` apart; where these are dealt out by them already,
    nothing is shuffled."""
    rest = [c for c in df.columns if c not in key_cols]
    none = lambda t: F.lit(None).cast(t)
    spans = df.schema[spans_col].dataType.elementType["end"].dataType.simpleString()
    kind = F.struct(*[F.col(c) for c in rest])
    held = T.StructType([df.schema[c] for c in rest]).simpleString()

    def mark(pos, order, idx, start, end, row):
        return F.struct(pos.cast("bigint").alias("pos"), F.lit(order).alias("order"), idx.cast("int").alias("idx"), start.cast("bigint").alias("start"),
                        end.cast("bigint").alias("end"), row.cast(held).alias("row"))

    first = F.array(mark(none("bigint"), 0, none("int"), none("bigint"), none("bigint"), kind))  # the row itself
    tokens = F.transform(F.col(offsets_col), lambda o, i: mark(o["end"], 1, i, o["start"], none(spans), none(held)))
    begun = F.transform(F.col(spans_col), lambda s: mark(s["start"], 2, none("int"), none("bigint"), s["end"], none(held)))
    empty = F.array().cast(f"array<struct<pos:bigint,order:int,idx:int,start:bigint,end:bigint,row:{held}>>")
    marks = df.select(*key_cols, F.inline(F.concat(first, F.coalesce(tokens, empty), F.coalesce(begun, empty))))
    w = Window.partitionBy(*key_cols).orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumn("_reach", F.max("end").over(w))
    mask = F.sort_array(F.collect_list(F.when(F.col("order") == 1, F.struct("idx", F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)).alias("m")))))
    got = marks.groupBy(*key_cols).agg(F.first("row", ignorenulls=True).alias("_row"), mask.alias("_mask"))
    return got.select(*key_cols, "_row.*", F.when(F.col(f"_row.{offsets_col}").isNotNull(), F.col("_mask.m")).alias(out))


def with_assistant_mask(df: DataFrame, text_col: str, offsets_col: str, pattern: str,
                        out: str = "loss_mask", key_cols: list[str] | None = None) -> DataFrame:
    """T5 + T6: spans of the pattern's group 1 in the text (Arrow UDF), then
    the overlap mask of the token offsets (JVM-side): by sweep where
    ``key_cols`` tell the rows apart, else span by span."""
    d = df.withColumn("_spans", assistant_spans(F.col(text_col), pattern))
    if key_cols:
        d = overlap_mask_sweep(d, key_cols, offsets_col, "_spans", out)
    else:
        d = d.withColumn(out, overlap_mask(F.col(offsets_col), F.col("_spans")))
    return d.withColumn("n_spans", F.size("_spans")).drop("_spans")


# ------------------------------------------------------------ T8 - T11
def min_valid_tokens(df: DataFrame, minimum: int, mask_col: str = "loss_mask") -> DataFrame:
    """Keep samples with at least ``minimum`` trainable tokens."""
    if minimum < 0:
        raise ValueError("minimum_valid_tokens must be >= 0")
    return df.filter(F.size(F.filter(mask_col, lambda x: x)) >= minimum)


def with_seq_len(df: DataFrame, ids_col: str = "input_ids", mask_col: str = "loss_mask") -> DataFrame:
    """``seq_len = size(ids)``; fails the job if ids and mask differ."""
    chk = F.assert_true(F.size(ids_col) == F.size(mask_col), F.lit("ids and mask lengths differ"))
    return df.withColumn("seq_len", F.when(chk.isNull(), F.size(ids_col)).cast("int"))


def span_counters(df: DataFrame, max_length: int, spans_col: str = "n_spans", len_col: str = "seq_len") -> DataFrame:
    """Samples without any trainable span, and those that also hit ``max_length``."""
    return df.agg(F.count_if(F.col(spans_col) == 0).cast("bigint").alias("no_span"),
                  F.count_if((F.col(spans_col) == 0) & (F.col(len_col) == max_length)).cast("bigint").alias("no_span_at_max"))


def mask_runs(tokens: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """Gaps-and-islands over token rows ``(key, pos, token, trainable)``:
    one row per maximal run of equal ``trainable`` values with its text.

    Tokens are joined with a single space (the regex tokenizer drops
    whitespace)."""
    w = Window.partitionBy(key_col).orderBy("pos")
    d = tokens.withColumn("_chg", F.when(F.lag("trainable").over(w).eqNullSafe(F.col("trainable")), 0).otherwise(1))
    d = d.withColumn("run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return (d.groupBy(key_col, "run")
             .agg(F.first("trainable").alias("trainable"), F.min("pos").alias("start"),
                  F.count(F.lit(1)).alias("n_tokens"),
                  F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))),
                                           lambda x: x["token"]), " ").alias("text")))
