"""Token counts with a whole-token shortcut.

Offline, once per tokenizer: every vocabulary string is encoded alone; those
that give exactly one token are proven whole tokens.  In a task a text is
cut into pre-tokens with the tokenizer's pattern, pre-tokens that are whole
tokens count as one, and only the rest is merged by the tokenizer's model
(each distinct one once, as long as the task remembers it).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from draftkit.llm.common import arrow_map, keyed_text, pieces

#: The pattern of the byte-level pre-tokenizer (fixed by the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern spelled out for texts below U+0250, where the plain engine
#: (twice as fast) needs no property tables: letters, numbers, white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
LOW_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Distinct merged pre-tokens that a worker remembers.
REMEMBER = 200_000
#: Longer texts are cut by an iterator instead of a list.
LONG = 1 << 20


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """Vocabulary strings (as texts) proven to encode alone as one token and
    to be one pre-token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    back = {c: b for b, c in byte_letters().items()}
    cut = regex.compile(PATTERN)
    texts = []
    for s in json.loads(tokenizer_json)["model"]["vocab"]:
        try:
            texts.append(bytes(back[c] for c in s).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # not a text by itself, so never a pre-token
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True)
                     if len(e.ids) == 1 and cut.findall(t) == [t])


class Counter(dict):
    """pre-token -> number of tokens; merges what it has not seen."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.room = whole, REMEMBER
        self.model = Tokenizer.from_str(tokenizer_json).model
        self.letters = str.maketrans({b: c for b, c in byte_letters().items()})

    def __missing__(self, pre: str) -> int:
        n = len(self.model.tokenize(pre.encode().decode("latin-1").translate(self.letters)))
        if len(pre) < 64:
            if not self.room:  # start over: memory stays bounded
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.room = REMEMBER
            self[pre] = n
            self.room -= 1
        return n


@lru_cache(maxsize=1)
def _counter(tokenizer_json: str, whole: frozenset[str]) -> Counter:
    """One per worker, so that tasks share what it has seen."""
    return Counter(tokenizer_json, whole)


def pre_tokens(text: str):
    """The pre-tokens of a text, in order."""
    engine = _LOW if not text or max(text) < "\u0250" else _ANY
    return engine.findall(text) if len(text) < LONG else (m.group() for m in engine.finditer(text))


_LOW, _ANY = re.compile(LOW_PATTERN), regex.compile(PATTERN)


def _supported(tokenizer_json: str) -> list[str]:
    """Contents of the special tokens; raises for a tokenizer of another
    kind, whose counts this operator would get wrong."""
    j = json.loads(tokenizer_json)
    pre = j["pre_tokenizer"] or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in j["added_tokens"])
    if (j["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or j["model"].get("type") != "BPE" or j["model"].get("dropout") or not plain):
        raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
    return [t["content"] for t in j["added_tokens"]]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit).

    Counts are those of the tokenizers library without begin, end or added
    special tokens; special strings inside a text are one token each, as in
    its default.  Null text is empty (0 and 0); repeated rows give repeated
    rows; an empty table gives none.  Texts are counted whole, long ones in
    the same single pass.  The tokenizer file is read by the driver and
    broadcast (a few MB, whatever the corpus).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    special = _supported(source)
    shared = docs.sparkSession.sparkContext.broadcast((source, whole_tokens(source)))
    split = "|".join(map(regex.escape, special)) or "(?!)"

    def run(batches):
        count, marks = _counter(*shared.value), regex.compile(split)
        for batch in batches:
            for part in pieces(batch):
                n = []
                for text in part.column(1).to_pylist():
                    segments = marks.split(text)
                    total = len(segments) - 1
                    for s in segments:
                        total += sum(map(count.__getitem__, pre_tokens(s)))
                    n.append(total)
                tokens = np.array(n, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pc.cast(pc.binary_length(part.column(1)), pa.int64()),
                    pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(keyed_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def text_counter(spark, tokenizer_path: str):
    """For other operators: a function that tasks call to get a function
    from a text to its number of tokens, as ``count_tokens`` counts them."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    special = _supported(source)
    shared = spark.sparkContext.broadcast((source, whole_tokens(source)))
    split = "|".join(map(regex.escape, special)) or "(?!)"

    def make():
        count, marks = _counter(*shared.value), regex.compile(split)

        def tokens(text: str) -> int:
            segments = marks.split(text)
            return len(segments) - 1 + sum(sum(map(count.__getitem__, pre_tokens(s))) for s in segments)
        return tokens
    return make
