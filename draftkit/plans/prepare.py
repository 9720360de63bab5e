"""Prepare plans: chat corpus -> tokenised samples -> draft vocabulary.

The eager steps are the tables written to the shared folder (tokenised
turns, starts of long conversations' turns, the vocabulary) and the size
checks that guard broadcasts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftkit.functions.joins import BROADCAST_MAX_BYTES
from draftkit.operators import normalize as N
from draftkit.operators import sample as R
from draftkit.operators import tokens as TK
from draftkit.operators import vocab as V
from draftkit.session import materialize


def truncated_turns(conversations: DataFrame, template: str = "chatml", max_length: int = 8192,
                    dropout_seed: int | None = None) -> DataFrame:
    """conversations rows -> (N5) -> N1/N2 -> T4/T7 per turn -> truncation."""
    rows = conversations
    if dropout_seed is not None:
        rows = N.turn_dropout_rows(rows, dropout_seed)
    rows = N.normalize_rows(rows)
    tok = TK.turn_tokens(rows, TK.TEMPLATES[template])
    return TK.truncate_turns(tok, max_length)


def corpus_tokens(conversations: DataFrame, template: str = "chatml", max_length: int = 8192) -> DataFrame:
    """Token rows ``(conv_id, pos, token, trainable)`` of the truncated samples."""
    return TK.token_positions(truncated_turns(conversations, template, max_length))


def draft_vocabulary(conversations: DataFrame, template: str = "chatml", max_length: int = 8192,
                     draft_vocab_size: int = 512) -> DataFrame:
    """Flagship: a draft vocabulary from a chat corpus.

    N1/N2 -> T1/T4/T7 -> truncation -> T13 ids -> V1 (trainable positions) ->
    V3 top-k -> V4 padding -> V5 ``d2t``.  Output
    ``(draft_id, target_id, offset, token, freq)``.
    """
    rows = N.normalize_rows(conversations)
    # tokenised once, into the shared folder: later reads prune columns
    tok = materialize(TK.turn_tokens(rows, TK.TEMPLATES[template]), "turn-tokens")
    # One pass over the token rows: total counts (ids) and trainable counts
    # (V1) together; later steps read only the vocabulary table.
    vocab = TK.build_vocabulary(TK.token_rows(TK.cut_long(tok, max_length)), extra_aggs=[F.count_if("trainable").alias("freq")])
    freq = vocab.filter(F.col("freq") > 0).select("token_id", "freq")
    sel = V.pad_selection(V.top_k(freq, draft_vocab_size), draft_vocab_size)
    d2t = V.draft_to_target(sel)
    return (d2t.join(vocab.select(F.col("token_id").alias("target_id"), "token", "freq"), "target_id", "left")
               .select("draft_id", "target_id", "offset", "token",
                       F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq")))


def prepared_samples(conversations: DataFrame, template: str = "chatml", max_length: int = 8192,
                     minimum_valid_tokens: int = 0) -> DataFrame:
    """Prepared samples ``(conv_id, input_ids, loss_mask, seq_len)``."""
    return samples_of_turns(N.normalize_rows(conversations), template, max_length, minimum_valid_tokens)


def samples_of_turns(rows: DataFrame, template: str = "chatml", max_length: int = 8192,
                     minimum_valid_tokens: int = 0) -> DataFrame:
    """Normalised turn rows -> prepared samples.

    Turns are tokenised once into the shared folder, cut, and assembled per
    sample by the one shuffle that carries token arrays.  Ids come from the
    (written) vocabulary table inside the partitions of that shuffle: by
    broadcast of its most frequent tokens, and for the others by a join of
    each sample's distinct tokens (``with_token_ids``)."""
    tok = materialize(TK.turn_tokens(rows, TK.TEMPLATES[template]), "turn-tokens")
    cut = TK.cut_long(tok, max_length)
    vocab = TK.build_vocabulary(TK.token_rows(cut))
    enc = TK.with_seq_len(TK.with_token_ids(TK.assembled(cut), vocab, BROADCAST_MAX_BYTES))
    return TK.min_valid_tokens(enc, minimum_valid_tokens)


def prepare_datasets(sources: dict[str, DataFrame], template: str = "chatml", max_length: int = 8192,
                     minimum_valid_tokens: int = 0, dropout_seed: int | None = None, shuffle_seed: int = 0,
                     max_samples: int | None = None) -> DataFrame:
    """JSON sources to prepared samples as one plan.

    ``sources`` maps a name (without ``:``) to a chat source as
    ``read_conversations`` gives it (``conversations`` or ``messages``).  With
    ``max_samples`` each source keeps three times as many conversations of
    its seeded order (R2) before any work is done on them.  Conversations are
    normalised in their own row (N1-N7: roles, tool calls, reasoning, typed
    parts and, with ``dropout_seed``, a prefix of the turns), turned into
    turn rows and prepared together; ``max_samples`` of the seeded order of
    all samples stay (R3, R4).  Output: ``(source, source_id, conv_id,
    input_ids, loss_mask, seq_len)``, ``conv_id`` being ``source:id``, or
    ``source:#row`` for a conversation without an id.  A list of parts gives
    its texts, one a line; tool calls follow a turn's text as JSON; reasoning
    is not rendered (as templates drop it from earlier turns)."""
    parts = []
    for k, (name, df) in enumerate(sources.items()):
        d = N.rename_messages(df).select(F.col("id").cast("string").alias("source_id"), F.col("conversations").alias("turns"),
                                         F.monotonically_increasing_id().alias("_row"))
        # written once, so row numbers stay when a task runs again
        d = materialize(N.drop_empty(d), "chat-source").withColumn("source", F.lit(name)).withColumn("source_ord", F.lit(k))
        d = d.withColumn("conv_id", F.concat(F.lit(f"{name}:"), F.coalesce("source_id", F.concat(F.lit("#"), F.col("_row").cast("string")))))
        parts.append(d.drop("_row") if max_samples is None else R.pre_cap(d.drop("_row"), max_samples, shuffle_seed, "conv_id"))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    normal = materialize(N.normalize_turns(every, "turns", dropout_seed, "conv_id"), "chat-normal")
    rows = N.unfold_turns(normal.select("conv_id", "turns"))
    rows = rows.select("conv_id", "turn", "role", N.turn_text().alias("text"))
    out = samples_of_turns(rows, template, max_length, minimum_valid_tokens)
    out = out.join(normal.select("conv_id", "source", "source_id", "source_ord"), "conv_id")
    if max_samples is not None:
        out = R.final_cap(out, max_samples, shuffle_seed + 1, "conv_id")
    return out.select("source", "source_id", "conv_id", "input_ids", "loss_mask", "seq_len")


def prepared_samples_tokenizer(conversations: DataFrame, tokenizer_path: str, template: str = "chatml",
                               max_length: int = 8192, pattern: str | None = None,
                               minimum_valid_tokens: int = 0) -> DataFrame:
    """Prepared samples with a ``tokenizers`` JSON file (T1, T4 b, T5, T6,
    T8, T9): each conversation is rendered to one text, encoded with
    offsets (truncated at ``max_length``), and tokens overlapping the
    assistant spans of ``pattern`` (default: detected from the template,
    T2/T3) are trainable.  The pattern path needs a conversation's whole
    rendered text in one row."""
    t = TK.TEMPLATES[template]
    if pattern is None:
        probe = TK.ChatTemplate(t.name + "-probe", t.bos, t.prefix, t.suffix, provides_mask=False)
        pattern = TK.choose_mask_source(None, probe)[1]
    rows = N.normalize_rows(conversations)
    pieces = TK.render_pieces(rows, t)
    texts = pieces.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("text"))
    enc = texts.withColumn("_e", TK.encode_with_tokenizer(F.col("text"), tokenizer_path, max_length))
    enc = enc.select("conv_id", "text", F.col("_e.ids").alias("input_ids"), F.col("_e.offsets").alias("offsets"))
    masked = TK.with_assistant_mask(enc, "text", "offsets", pattern, "loss_mask", key_cols=["conv_id"])
    out = TK.with_seq_len(masked.select("conv_id", "input_ids", "loss_mask", "n_spans"))
    return TK.min_valid_tokens(out, minimum_valid_tokens)
