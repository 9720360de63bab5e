"""Chat formatting of typed content parts, in DataFrame functions only.

A turn holds an ordered list of typed parts (text, image, audio, document).
The visitor flattens them to one string: text is escaped, every other part
becomes a placeholder mark, its reference is recorded in order, and the
tokens it expands to are counted from its units (image tiles, audio
seconds, document pages).

Marks: ``<|turn|>role<|text|>body<|end|>``; an assistant's body opens with
``<|loss|>`` in place of ``<|text|>``, which is the loss mask.  Control
strings inside texts and roles are escaped reversibly: backslashes are
doubled, then a backslash goes between the first two characters of every
control string.  In an escaped text a single backslash can only come from
the second rule, so undoing it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftkit.llm.common import column

#: Control strings: the opening of this template's marks, and those of a
#: common older template.  No one of them starts with the end of another.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>")
#: Tokens per unit of an attachment.
EXPANSION = {"image": 256, "audio": 25, "document": 600, "file": 1}

PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for s in CONTROL:
        c = F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def _kind(p: Column) -> Column:
    """A part's kind; unknown or missing kinds with text are text, without
    it files."""
    t = F.lower(p["type"])
    return (F.when(t.isin("text", *EXPANSION), t)
            .when(p["text"].isNotNull(), F.lit("text")).otherwise(F.lit("file")))


def _visit(p: Column) -> Column:
    k = _kind(p)
    return F.when(k == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), k, F.lit("|>")))


def _expanded(p: Column) -> Column:
    per = F.lit(0)
    for k, n in EXPANSION.items():
        per = F.when(_kind(p) == k, F.lit(n)).otherwise(per)
    return (F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0)) * per).cast("bigint")


def text_parts(c: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and
    length in code points of every assistant body), attachments (ordinal,
    kind, ref, tokens; in order of their placeholders), attachment_tokens.

    Turns go by ``turn``, ties by role and rendered body.  A null role or
    parts list is empty; null parts inside a list are left out.  Null
    conversation ids are one conversation.  An empty table gives no rows.
    A conversation is one row by definition, so it must fit a row.
    """
    ps = F.filter(F.coalesce(column(turns, parts).cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    rows = turns.select(column(turns, conv).alias("conv_id"), column(turns, turn).alias("turn"),
                        F.coalesce(column(turns, role), F.lit("")).alias("role"), ps.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", F.concat_ws("", F.transform("parts", _visit)).alias("body"),
                       F.transform(F.filter("parts", lambda p: _kind(p) != "text"),
                                   lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))).alias("files"))
    loss = F.col("role") == "assistant"
    rows = rows.withColumn("head", F.concat(F.lit("<|turn|>"), escape(F.col("role")), F.when(loss, "<|loss|>").otherwise("<|text|>")))
    rows = rows.withColumn("chars", F.char_length("head") + F.char_length("body") + F.lit(len("<|end|>")))
    # the window and the aggregate share one exchange by conversation
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "at", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "head", "body", "role", "at", "files"))).alias("t"))
    files = F.flatten(F.transform("t", lambda t: t["files"]))
    return got.select(
        "conv_id",
        F.concat_ws("", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit("<|end|>")))).alias("formatted"),
        F.transform(F.filter("t", lambda t: t["role"] == "assistant"),
                    lambda t: F.struct((t["at"] + F.char_length(t["head"])).cast("bigint").alias("start"),
                                       F.char_length(t["body"]).cast("bigint").alias("length"))).alias("loss_spans"),
        F.transform(files, lambda f, i: F.struct(i.cast("bigint").alias("ordinal"), f["kind"].alias("kind"), f["ref"].alias("ref"),
                                                 f["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"))


def _plain(body: Column) -> Column:
    """A body's text: placeholders leave, escapes are undone."""
    return unescape(F.regexp_replace(body, r"<\|(image|audio|document|file)\|>", ""))


def read_turns(formatted: Column) -> Column:
    """The (role, text) list of a formatted conversation."""
    found = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|turn\|>(.*?)<\|end\|>"), F.lit(1))
    return F.transform(found, lambda t: F.struct(
        unescape(F.regexp_extract(t, r"(?s)^(.*?)<\|(text|loss)\|>", 1)).alias("role"),
        _plain(F.regexp_replace(t, r"(?s)^.*?<\|(text|loss)\|>", "")).alias("text")))


def read_loss(formatted: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(r"(?s)<\|loss\|>(.*?)<\|end\|>"), F.lit(1)), _plain)
