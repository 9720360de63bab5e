"""Normalisation of chat conversations (roles, content, parts, dropout).

Two shapes are supported:

* nested -- one row per conversation, ``turns: array<struct>`` (chat JSON);
  the per-turn rules are written once as struct expressions and applied with
  ``transform``/``filter`` (no shuffle, no UDF);
* long   -- one row per turn ``(conv_id, turn, role, text)`` as in the
  ``conversations`` table; per-conversation facts come from aggregations and
  salted running sums, so a conversation with a huge number of turns never
  sits in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftkit import schemas
from draftkit.functions.index import group_rank
from draftkit.functions.keys import hash32
from draftkit.session import materialize

# Accepted role spellings and their normal form.  Any other
# role drops the turn.
ROLE_ALIASES = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "system": "system",
    "tool": "tool",
}
MEDIA_KINDS = ("image", "video", "audio")


def _role_map() -> Column:
    items = []
    for k, v in ROLE_ALIASES.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def normalize_role(raw_role: Column) -> Column:
    """Alias lookup; NULL for unknown roles."""
    return F.element_at(_role_map(), F.coalesce(raw_role, F.lit("")))


def _nonempty(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def normalize_content(value: Column, content: Column) -> Column:
    """``value`` wins, an empty ``value`` falls through to ``content``,
    then ``""``."""
    return F.coalesce(_nonempty(value), _nonempty(content), F.lit(""))


def normalize_turn(t: Column, has_parts: bool = True) -> Column:
    """N1-N4 on one raw turn struct -> normalised turn struct (role NULL when
    the turn is to be dropped).

    A turn with ``parts`` keeps them as they are; any other content is plain
    text, whatever it starts with."""
    raw_role = F.coalesce(t["from"], t["role"])
    thinking = F.coalesce(_nonempty(t["thinking"]), _nonempty(t["reasoning_content"]))
    text = normalize_content(t["value"], t["content"])
    no_parts = F.lit(None).cast(T.ArrayType(schemas.PART))
    # an empty list counts as no content, so the text (or "") stands in
    parts = F.when(F.size(t["parts"]) > 0, t["parts"]) if has_parts else no_parts
    return F.struct(
        normalize_role(raw_role).alias("role"),
        (F.when(parts.isNull(), text) if has_parts else text).alias("content"),
        parts.alias("parts"),
        F.when(F.size(t["tool_calls"]) > 0, t["tool_calls"]).alias("tool_calls"),
        _nonempty(t["tool_call_id"]).alias("tool_call_id"),
        thinking.alias("thinking"),
        thinking.alias("reasoning_content"),
    )


def _part(**given) -> Column:
    return F.struct(*[given.get(f.name, F.lit(None)).cast("string").alias(f.name) for f in schemas.PART.fields])


def variant_parts(v: Column) -> Column:
    """A variant list of parts (strings or typed objects) ->
    ``array<PART>``; a bare string becomes a text part."""
    def one(p):
        known = {f.name: F.try_variant_get(p, f"$.{f.name}", "string") for f in schemas.PART.fields}
        return F.when(F.schema_of_variant(p) == "STRING", _part(type=F.lit("text"), text=F.try_variant_get(p, "$", "string"))).otherwise(_part(**known))
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), one)


def typed_turn(t: Column) -> Column:
    """A turn as read from JSON (``schemas.JSON_TURN``) -> ``RAW_TURN``:
    ``value`` wins over ``content`` where it is not empty; a JSON list becomes
    ``parts``, anything else text."""
    def is_list(v):
        return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))

    def text(v):
        return F.when(~is_list(v), F.try_variant_get(v, "$", "string"))

    def items(v):
        return F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>"))
    value_wins = (F.coalesce(text(t["value"]), F.lit("")) != "") | (F.coalesce(F.size(items(t["value"])), F.lit(-1)) > 0)
    winner = F.when(value_wins, t["value"]).otherwise(t["content"])
    made = {"value": F.lit(None).cast("string"), "content": text(winner), "parts": F.when(is_list(winner), variant_parts(winner))}
    return F.struct(*[made.get(f.name, t[f.name] if f.name not in made else None).alias(f.name) for f in schemas.RAW_TURN.fields])


def normalize_turns(df: DataFrame, turns_col: str = "turns", dropout_seed: int | None = None,
                    key_col: str = "conv_id") -> DataFrame:
    """N1-N6 on nested conversations.

    With ``dropout_seed`` (N5) a number ``n`` in ``[1, len(raw turns)]`` is
    drawn per conversation from ``hash(seed, key)``; turns are kept up to the
    first assistant turn whose raw index ``i`` has ``i + 1 >= n`` (all turns
    if there is none).  Conversations that are empty before or after
    normalising are dropped (N6).
    """
    raw = F.col(turns_col)
    has_parts = "parts" in df.schema[turns_col].dataType.elementType.names
    tagged = F.transform(raw, lambda t, i: F.struct(normalize_turn(t, has_parts).alias("t"), i.alias("i")))
    d = df.filter(F.size(raw) > 0).withColumn("_tt", tagged)
    keep = lambda x: x["t"]["role"].isNotNull()
    if dropout_seed is not None:
        n = F.lit(1) + F.pmod(hash32(dropout_seed, key_col), F.size(raw))
        cut = F.array_min(F.transform(
            F.filter("_tt", lambda x: (x["t"]["role"] == "assistant") & (x["i"] + 1 >= n)),
            lambda x: x["i"]))
        d = d.withColumn("_cut", cut)
        keep = lambda x: x["t"]["role"].isNotNull() & (F.col("_cut").isNull() | (x["i"] <= F.col("_cut")))
    d = d.withColumn(turns_col, F.transform(F.filter("_tt", keep), lambda x: x["t"]))
    d = d.drop("_tt", "_cut")
    return d.filter(F.size(turns_col) > 0)


def normalize_rows(df: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """N1/N2 on long-form turn rows; rows with unknown roles are dropped."""
    return (df.withColumn(role_col, normalize_role(F.col(role_col)))
              .withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
              .filter(F.col(role_col).isNotNull()))


def turn_dropout_rows(df: DataFrame, seed: int, key_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role") -> DataFrame:
    """N5 on long-form rows (roles *raw*; normalise afterwards).

    The raw index of a turn is its position among all turns of the
    conversation (salted running count, so hot conversations stay split);
    ``n`` is drawn per conversation, the cut is the first assistant turn
    whose raw index has ``index + 1 >= n``.  All of this runs on narrow
    ``(key, turn, role)`` rows; the full rows (with their text) are shuffled
    once, by the join with one row per conversation that is cut.
    """
    narrow = materialize(group_rank(df.select(key_col, turn_col, role_col), [key_col], turn_col, "_i"), "dropout-ranks")
    per = narrow.groupBy(key_col).agg(F.count(F.lit(1)).alias("_len"))
    n = F.lit(1) + F.pmod(hash32(seed, key_col), F.col("_len"))
    last = F.when((normalize_role(F.col(role_col)) == "assistant") & (F.col("_i") + 1 >= n), F.col(turn_col))
    # one row per conversation: the last turn that is kept (null: all are)
    cut = narrow.join(per, key_col).groupBy(F.col(key_col).alias("_k")).agg(F.min(last).alias("_cut"))
    cut = cut.filter(F.col("_cut").isNotNull())
    return (df.join(cut, F.col(key_col) == F.col("_k"), "left")
              .filter(F.col("_cut").isNull() | (F.col(turn_col) <= F.col("_cut"))).drop("_k", "_cut"))


def fold_turns(df: DataFrame, key_col: str = "conv_id", turn_col: str = "turn",
               role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Flat turn rows -> one row per conversation with ordered ``turns``.

    One output row holds one whole conversation by definition; the shuffle is
    on the conversation key and partial aggregation is not possible for
    ``collect_list``, so very long conversations should be cut (T4
    ``max_length``) before folding.
    """
    s = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                 F.col(text_col).alias("content"))
    return (df.groupBy(key_col)
              .agg(F.sort_array(F.collect_list(s)).alias("turns")))


def unfold_turns(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Nested -> long form with the position as ``turn``."""
    others = [c for c in df.columns if c != turns_col]
    return df.select(*others, F.posexplode(turns_col).alias("turn", "t")).select(
        *others, F.col("turn").cast("long"), "t.*")


def turn_text(content: str = "content", parts: str = "parts", tool_calls: str = "tool_calls") -> Column:
    """The text of a normalised turn: its content, or its text parts one a
    line; tool calls follow as JSON."""
    listed = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")
    text = F.coalesce(F.col(content), listed, F.lit(""))
    return F.concat(text, F.when(F.col(tool_calls).isNotNull(), F.concat(F.when(text != "", "\n").otherwise(""), F.to_json(tool_calls))).otherwise(""))


def drop_empty(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Drop conversations with no turns (NULL or empty)."""
    return df.filter(F.coalesce(F.size(turns_col), F.lit(0)) > 0)


def rename_messages(df: DataFrame) -> DataFrame:
    """``messages`` -> ``conversations`` when present."""
    if "messages" in df.columns and "conversations" not in df.columns:
        return df.withColumnRenamed("messages", "conversations")
    if "messages" in df.columns:
        return df.withColumn("conversations", F.coalesce("conversations", "messages")).drop("messages")
    return df


def qa_to_turns(df: DataFrame, question: str = "question", answer: str = "answer",
                out: str = "turns") -> DataFrame:
    """question/answer columns -> a two-turn conversation."""
    return df.withColumn(out, F.array(
        F.struct(F.lit("user").alias("role"), F.col(question).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("content"))))


def prefix_filter(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Keep rows whose ``col`` starts with ``prefix`` (pushed to the scan)."""
    return df.filter(F.col(col).startswith(prefix))


def rewrite_path(col: Column | str, strip_prefix: str, base_dir: str) -> Column:
    """Drop ``strip_prefix`` and put ``base_dir`` in front."""
    c = col if isinstance(col, Column) else F.col(col)
    base = base_dir if base_dir.endswith("/") else base_dir + "/"
    stripped = F.when(c.startswith(strip_prefix), c.substr(F.lit(len(strip_prefix) + 1), F.length(c))).otherwise(c)
    return F.concat(F.lit(base), stripped)


def check_paths(df: DataFrame, path_col: str, listing: DataFrame, strict: bool = True) -> DataFrame:
    """N11 existence check against a file listing (``path`` column, e.g. a
    ``binaryFile`` scan with the content pruned).  Missing paths come from a
    ``left_anti`` join; ``strict`` makes the job fail on them (``raise_error``
    at execution, no driver round trip), otherwise they get a
    ``reject_reason``."""
    known = listing.select(F.col("path").alias(path_col)).distinct()
    missing = (df.select(path_col).distinct().join(known, path_col, "left_anti")
                 .withColumn("_missing", F.lit(True)))
    d = df.join(missing, path_col, "left")
    if strict:
        return d.withColumn(path_col, F.when(
            F.col("_missing"), F.raise_error(F.concat(F.lit("no file at "), F.col(path_col)))
        ).otherwise(F.col(path_col))).drop("_missing")
    return d.withColumn("reject_reason", F.when(F.col("_missing"), F.lit("missing file"))).drop("_missing")


def image_caption_parts(df: DataFrame, turns_col: str, image_path: Column) -> DataFrame:
    """User text split on newlines; a line equal to ``<image>`` becomes an
    image part with ``image_path``, other lines text parts; assistant text is
    one text part."""
    def part(kind, text, path):
        return F.struct(*[
            (kind if f.name == "type" else text if f.name == "text" else path if f.name == "path"
             else F.lit(None).cast("string")).alias(f.name) for f in schemas.PART.fields])

    def conv_turn(t):
        role = normalize_role(F.coalesce(t["from"], t["role"]))
        txt = normalize_content(t["value"], t["content"])
        user_parts = F.transform(F.split(txt, "\n"), lambda line: F.when(
            line == "<image>", part(F.lit("image"), F.lit(None).cast("string"), image_path)
        ).otherwise(part(F.lit("text"), line, F.lit(None).cast("string"))))
        asst = F.array(part(F.lit("text"), txt, F.lit(None).cast("string")))
        return F.struct(role.alias("role"), F.lit(None).cast("string").alias("content"),
                        F.when(role == "user", user_parts).otherwise(asst).alias("parts"))
    return df.withColumn(turns_col, F.transform(F.col(turns_col), conv_turn))


def media_part_to_url(p: Column) -> Column:
    """Typed part -> request part.

    Returns ``struct(type, text, url, reject)``: text stays text; a media
    part with ``path`` becomes ``{m}_url`` with ``file://`` + absolute path,
    with ``url`` the URL itself; inline/base64 media and unknown parts get a
    ``reject`` reason (callers quarantine or ``raise_error`` on it).
    """
    kind = p["type"]
    is_media = kind.isin(*MEDIA_KINDS)
    path = p["path"]
    abs_path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    url = F.when(path.isNotNull() & (path != ""), F.concat(F.lit("file://"), abs_path)).when(
        p["url"].isNotNull() & (p["url"] != ""), p["url"])
    inline = F.coalesce(
        F.when(kind == "image", p["image"]), F.when(kind == "video", p["video"]),
        F.when(kind == "audio", p["audio"]))
    reject = (F.when(kind == "text", F.lit(None))
               .when(is_media & url.isNotNull(), F.lit(None))
               .when(is_media & (F.coalesce(p["base64"], F.lit("")) != ""), F.concat(kind, F.lit(" base64 not supported")))
               .when(is_media & (F.coalesce(inline, F.lit("")) != ""), F.concat(kind, F.lit(" inline data not supported")))
               .otherwise(F.concat(F.lit("unknown content part: "), F.coalesce(kind, F.lit("?")))))
    return F.struct(
        F.when(kind == "text", F.lit("text")).when(is_media, F.concat(kind, F.lit("_url"))).alias("type"),
        F.when(kind == "text", p["text"]).alias("text"),
        F.when(is_media, url).alias("url"),
        reject.cast("string").alias("reject"),
    )


def has_multimodal(turns: Column) -> Column:
    """Any turn whose content is a list of parts."""
    return F.exists(turns, lambda t: t["parts"].isNotNull())


def request_payload(df: DataFrame, ids_col: str = "input_ids", turns_col: str = "turns") -> DataFrame:
    """Token ids always; the messages only for multimodal samples."""
    return df.select("*", F.struct(
        F.col(ids_col).alias("prompt_token_ids"),
        F.when(has_multimodal(F.col(turns_col)), F.col(turns_col)).alias("messages")).alias("payload"))


def quarantine(df: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, failed) by a nullable error column."""
    return df.filter(F.col(error_col).isNull()), df.filter(F.col(error_col).isNotNull())
