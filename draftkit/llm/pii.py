"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs,
digits' places, schemes and identifier cues.  Around each anchor a
deterministic local parser expands to the left and right, and validates the
boundaries and the value (Luhn, octets, digit counts, mod 97).

Base kinds (leftmost, non-overlapping per kind; a failing match is dropped
and not retried): email, ip, card, phone.  Kinds that the anchors add: url
(a scheme with user data before an at-sign), iban (mod 97), account (a cue
and its number), secret (a cue and its value).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from draftkit.llm.common import arrow_map, keyed_text, pieces

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "account", "secret")
KINDS = BASE_KINDS + MORE_KINDS

DIGITS = frozenset("0123456789")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL = frozenset(_LETTERS) | DIGITS | frozenset("._%+-")
LABEL = frozenset(_LETTERS) | DIGITS | frozenset("-")
ALNUM = frozenset(_LETTERS) | DIGITS
PHONE = DIGITS | frozenset(" ().-")
VALUE = ALNUM | frozenset("+/=_-")

#: Anchors and what they start (fixed values).
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
ACCOUNT_CUES = ("account", "acct", "a/c", "konto", "compte", "cuenta", "iban", "ssn")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for words, kind in ((SCHEMES, "url"), (ACCOUNT_CUES, "account"), (SECRET_CUES, "secret"), (("@",), "email"), (("+",), "phone")):
        for w in words:
            a.add_word(w, (kind, len(w)))
    for d in sorted(DIGITS):
        a.add_word(d, ("digit", 1))
    a.make_automaton()
    return a


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset, floor: int) -> int:
    """Start of the run of allowed characters that ends before ``at``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = _back(text, at, LOCAL, floor)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, LABEL)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels else None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _chain(text: str, at: int, joints: str) -> list[tuple[int, int]]:
    """Runs of digits from ``at``, joined by single joint characters."""
    runs = []
    while True:
        end = _run(text, at, DIGITS)
        runs.append((at, end))
        if end + 1 < len(text) and text[end] in joints and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return runs


def _octet(run: str) -> bool:
    run = run.lstrip("0")
    return len(run) <= 3 and int(run or "0") <= 255


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """The greedy match from a plus sign, whatever its number of digits."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 else None


def _url(text: str, at: int) -> tuple[int, bool]:
    """An address's end, and whether it carries user data before its
    at-sign."""
    end = at
    while end < len(text) and not text[end].isspace() and text[end] not in "<>\"'":
        end += 1
    host = text[at:end].partition("://")[2].partition("/")[0]
    return end, "@" in host[1:] and host[-1] != "@"


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """Two letters, two digits, 11 to 30 more, single spaces between, right
    by mod 97."""
    end, got = at, ""
    while end < len(text) and len(got) < 34:
        if text[end] in ALNUM:
            got += text[end]
        elif not (text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM):
            break
        end += 1
    while len(got) >= 15:
        if got[:2].isalpha() and got[2:4].isdigit() and int("".join(str(int(c, 36)) for c in got[4:] + got[:4])) % 97 == 1:
            return at, end
        # the longest prefix that ends where a group ends
        cut = text.rfind(" ", at, end)
        if cut < 0:
            return None
        end = cut
        got = text[at:end].replace(" ", "")
    return None


def _after_cue(text: str, at: int) -> int:
    """Where a cue's value starts: after a word's rest such as ``no.``,
    blanks, and one of ``: = #``."""
    m = _CUE_GAP.match(text, at)
    return m.end()


_CUE_GAP = re.compile(r"(?:[ \t]{0,2}(?:number|num|no|nr)\.?)?[ \t]{0,3}[:=#]?[ \t]{0,3}[\"']?", re.IGNORECASE)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start, then by kind in
    the order of KINDS.  Offsets are code points, ends exclusive."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "digit"), 0)  # where a kind's last match ended
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    for last, (kind, size) in _automaton().iter(low):
        at = last - size + 1
        if kind == "digit":
            if at < done["digit"]:
                continue
            digits_end = _run(text, at, DIGITS)
            if at >= done["card"]:
                runs = _chain(text, at, " -")
                done["card"] = end = runs[-1][1]
                digits = "".join(text[a:b] for a, b in runs) if 14 <= end - at <= 37 else ""
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, end))
            if at >= done["ip"]:
                runs = _chain(text, at, ".")
                for i in range(0, len(runs) - 3, 4):
                    if all(_octet(text[a:b]) for a, b in runs[i:i + 4]):
                        out.append(("ip", runs[i][0], runs[i + 3][1]))
                done["ip"] = runs[-1][1]
            done["digit"] = digits_end
        elif kind == "email":
            if got := _email(text, at, done["email"]):
                out.append(("email", *got))
                done["email"] = got[1]
        elif kind == "phone":
            if at >= done["phone"] and (got := _phone(text, at)):
                done["phone"] = got[1]
                if 10 <= sum(c in DIGITS for c in text[got[0]:got[1]]) <= 15:
                    out.append(("phone", *got))
        elif kind == "url":
            if at >= done["url"]:
                done["url"], personal = _url(text, at)
                if personal:
                    out.append(("url", at, done["url"]))
        elif at == 0 or text[at - 1] not in ALNUM:
            start = _after_cue(text, last + 1)
            if kind == "account":
                if start >= done["iban"] and (got := _iban(text, start)):
                    out.append(("iban", *got))
                    done["iban"] = got[1]
                elif start > last + 1 and start >= done["account"]:
                    runs = _chain(text, start, " -") if start < len(text) and text[start] in DIGITS else [(start, start)]
                    end = runs[-1][1]
                    if 6 <= sum(b - a for a, b in runs) <= 17 and _run(text, end, ALNUM) == end:
                        out.append(("account", start, end))
                        done["account"] = end
            elif start > last + 1 and start >= done["secret"]:
                end = _run(text, start, VALUE)
                value = text[start:end]
                if end - start >= 16 and any(c in DIGITS for c in value) and not value.isdigit():
                    out.append(("secret", start, end))
                    done["secret"] = end
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


_ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans
    the first that starts counts, extended to the end of the others."""
    out, at, end_of = [], 0, 0
    merged: list[list] = []
    for k, a, b in spans:
        if merged and a < end_of:
            merged[-1][2] = end_of = max(end_of, b)
        else:
            merged.append([k, a, b])
            end_of = b
    for k, a, b in merged:
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> for every kind, base_sha256
    (hex digest of the base spans joined as kind:start:end), spans (all,
    joined likewise); with ``with_text`` also the redacted text.

    Null and empty texts have no spans; repeated rows give repeated rows; an
    empty table gives none.  Texts are read whole in one pass per text.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch):
                texts = part.column(1).to_pylist()
                found = [find_spans(t) for t in texts]
                cols = [part.column(0)]
                cols += [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in KINDS]
                base = [joined([s for s in f if s[0] in BASE_KINDS]) for f in found]
                cols.append(pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()))
                cols.append(pa.array([joined(f) for f in found], pa.string()))
                if with_text:
                    cols.append(pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["redacted"] * with_text]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", redacted string" * with_text
    return arrow_map(keyed_text(docs, id_col, text_col), run, schema)
