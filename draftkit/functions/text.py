"""Text expressions: the regex tokenizer and text pieces."""

from __future__ import annotations

import regex as _re
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.  Token = a run of letters/digits, or one other non-space
# character.  ``\p{L}\p{N}`` (not ``\w``) keeps accented letters inside words
# in both Java regex and RE2.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
# Pieces cover the text exactly (whitespace runs included), so character
# offsets are prefix sums of piece lengths.
PIECE_PATTERN = r"[\p{L}\p{N}]+|\s+|[^\p{L}\p{N}\s]"

_TOKEN_RX = _re.compile(TOKEN_PATTERN)


def tokenize(text) -> Column:
    """Tokens of ``text`` as ``array<string>`` (JVM regex, no UDF)."""
    t = text if isinstance(text, Column) else F.col(text)
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def tokenize_local(s: str) -> list[str]:
    """Same tokenizer in Python, for template constants on the driver."""
    return _TOKEN_RX.findall(s or "")
