"""Language ID by Bayesian evidence fusion.

1. Text likelihood: hashed byte trigrams, counted per language over all
   training texts by grouped sums; a page's mean log likelihood times at
   most FULL trigrams (further ones of a page say little that is new).
2. Declared language of the markup, and the address's suffix (a language
   code in the path, else the top-level domain, where it names a known
   language): likelihoods from counts over all pages of what the markup or
   suffix says beside what the text says, so unreliable marks weigh little.
3. Host prior, smoothed hierarchically: the host's counts of text languages
   lean on its domain's, the domain's on those of all pages; a page's own
   count is left out.
4. The posterior is the normalised product.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftkit.llm.common import arrow_map, column, pieces, written

BUCKETS, FULL = 1 << 14, 200
#: Pseudo-counts: of a trigram, of a mark, of the domain in the host, of all
#: pages in the domain.
TRIGRAM, MARK, IN_HOST, IN_DOMAIN = 0.5, 1.0, 5.0, 20.0
#: A model holds a table of BUCKETS numbers for each language, so there is a
#: limit to their number; more is an error.
MOST_LANGUAGES = 256

_LEFT_OUT = re.compile(r"<!--|<(?:(script|style)(?=[\s/>])|(nav|header|footer|noscript|template)(?=[\s/>])[^>]*>)", re.IGNORECASE)
_END = {None: re.compile("-->"), **{t: re.compile(rf"</{t}\s*>", re.IGNORECASE)
                                    for t in ("script", "style", "nav", "header", "footer", "noscript", "template")}}
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_CODE = re.compile(r"[a-z]{2,3}\Z")


def page_text(markup: str) -> str:
    """The text outside of scripts, styles, comments and the tags around a
    page's own text (nav, header, footer, noscript, template; by their whole
    names).  A script, style or comment that is not closed goes on to the
    page's end; of the other tags one that closes itself, or that nothing
    closes, is a tag like any other and the text after it stays."""
    out, at, look, never = [], 0, 0, set()
    while m := _LEFT_OUT.search(markup, look):
        name = (m[1] or m[2] or "").lower() or None
        end = None if name in never else _END[name].search(markup, m.end())
        if m[2] and (end is None or m[0].endswith("/>")):
            if end is None:
                never.add(name)
            look = m.end()
            continue
        out.append(markup[at:m.start()])
        at = look = end.end() if end else len(markup)
    out.append(markup[at:])
    return html.unescape(_TAG.sub(" ", " ".join(out)))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, white space
    collapsed."""
    b = np.frombuffer(_SPACE.sub(" ", f" {text.lower()} ").encode(), np.uint8).astype(np.uint32)
    if len(b) < 4:  # an empty text, or a single byte between blanks
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


def declared_language(markup: str) -> str:
    m = _DECLARED.search(markup)
    return m.group(1).lower() if m else ""


def address(url: str) -> tuple[str, str, str]:
    """(host, domain, suffix): the domain is the host's last two labels; the
    suffix a two or three letter first path segment, else the last label."""
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return "", "", ""
    path = parts.path.strip("/").split("/")[0].lower().split("-")[0]
    return host, ".".join(host.split(".")[-2:]), path if _CODE.match(path) else host.rpartition(".")[2]


def fit_text(training: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of the trigram buckets.  Rows
    without a language, and languages without a trigram, are left out."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"over {MOST_LANGUAGES} languages")
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = training.select(F.lower(F.trim(column(training, lang_col).cast("string"))).alias("lang"), column(training, text_col).cast("string").alias("text"))
    counts = written(arrow_map(rows.where("lang <> '' and text is not null"), count, "lang string, bucket long, n long")
                     .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    table = np.full((len(langs), BUCKETS), TRIGRAM)
    place = {x: i for i, x in enumerate(langs)}
    # at most BUCKETS rows a language, whatever the corpus
    for r in counts.toLocalIterator():
        table[place[r.lang], r.bucket] += r.n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


EVIDENCE = "page_id long, host string, domain string, declared int, suffix int, text_lang int, loglik array<double>"


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A narrow row per page.  ``declared`` and ``suffix`` are places in
    ``langs``, one more for another value, two more for none; ``text_lang``
    is null where the text says nothing."""
    shared = pages.sparkSession.sparkContext.broadcast((langs, model.astype(np.float32).T.copy()))

    def run(batches):
        langs, table = shared.value
        place = {x: i for i, x in enumerate(langs)}
        mark = lambda x: place.get(x, len(langs) if x else len(langs) + 1)
        for batch in batches:
            for part in pieces(batch, 64):
                rows = []
                for i, url, markup in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    grams = trigrams(page_text(markup))
                    host, domain, suffix = address(url)
                    if len(grams) and langs:
                        ll = table[grams].mean(axis=0, dtype=np.float64) * min(len(grams), FULL)
                        ll -= ll.max()
                    else:
                        ll = np.zeros(len(langs))
                    rows.append((i, host, domain, mark(declared_language(markup)), mark(suffix), int(ll.argmax()) if ll.any() else None, ll.tolist()))
                cols = [*zip(*rows, strict=True)] or [[] for _ in range(7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    text = lambda c: F.coalesce(column(pages, c).cast("string"), F.lit("")).alias(c)
    return arrow_map(pages.select(column(pages, id_col).cast("bigint").alias("page_id"), text(url_col), text(html_col)), run, EVIDENCE)


_NAMES = [x.split()[0] for x in EVIDENCE.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]


def _tally(n: int) -> list[Column]:
    """Counts of each text language: ordinary sums, combined map-side."""
    return [F.count_if(F.col("text_lang") == i).alias(f"n{i}") for i in range(n)]


def _marks(rows: DataFrame, mark: str, n: int) -> np.ndarray:
    """Log P(mark | language), from counts of all pages (n + 2 rows)."""
    table = np.full((n, n + 2), MARK)
    for r in rows.groupBy(mark).agg(*_tally(n)).collect():
        table[:, r[0]] += np.array(r[1:], float)
    return np.log(table / table.sum(axis=1, keepdims=True))


def identify(pages: DataFrame, training: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per page row: page_id, lang, probability, text_lang (null
    where the text says nothing), declared and suffix (a known language,
    ``other`` or empty), host.

    Null addresses and markup are empty; what is empty says nothing, and a
    page without any evidence gets the most frequent language.  Ties go to
    the first language in order.  Repeated rows give repeated rows; an empty
    table gives none; without training texts lang is null.
    """
    langs, model = fit_text(training, lang_col, text_col)
    n = len(langs)
    rows = written(evidence(pages, langs, model, id_col, url_col, html_col), "language-evidence")
    names = F.array(*[F.lit(x) for x in [*langs, "other", ""]])
    if not n:
        null = F.lit(None).cast("string")
        return rows.select("page_id", null.alias("lang"), F.lit(None).cast("double").alias("probability"), null.alias("text_lang"),
                           *[F.get(names, c).alias(c) for c in ("declared", "suffix")], "host")
    marks = {m: _marks(rows, m, n) for m in ("declared", "suffix")}
    counts = [f"n{i}" for i in range(n)]
    hosts = rows.groupBy("host", "domain").agg(*_tally(n))
    domains = hosts.groupBy(F.col("domain").alias("d")).agg(F.array(*[F.sum(c) for c in counts]).alias("in_domain"))
    hosts = hosts.join(domains, F.col("domain") == F.col("d")).select(F.col("host").alias("h"), F.array(*counts).alias("in_host"), "in_domain")
    every = np.array(rows.agg(*_tally(n)).first(), float)
    every = (every + 1) / (every + 1).sum()

    # a host has one row here; AQE splits a hot host's pages
    df = rows.join(hosts, F.col("host") == F.col("h"))
    at = lambda m: F.element_at(F.array(*[F.array(*map(F.lit, marks[m][:, k].tolist())) for k in range(n + 2)]), F.col(m) + 1)
    own = lambda i: (F.coalesce(F.col("text_lang"), F.lit(-1)) == i).cast("double")
    any_own = F.col("text_lang").isNotNull().cast("double")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    df = df.withColumns({"t_host": total(F.col("in_host")), "t_domain": total(F.col("in_domain")), "p_declared": at("declared"), "p_suffix": at("suffix")})
    scores = []
    for i in range(n):
        p_domain = (F.col("in_domain")[i] - own(i) + F.lit(IN_DOMAIN * float(every[i]))) / (F.col("t_domain") - any_own + IN_DOMAIN)
        p_host = (F.col("in_host")[i] - own(i) + p_domain * IN_HOST) / (F.col("t_host") - any_own + IN_HOST)
        scores.append(F.col("loglik")[i] + F.col("p_declared")[i] + F.col("p_suffix")[i] + F.log(p_host))
    df = df.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    rest = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return df.select("page_id", F.get(names, F.array_position("scores", F.col("top")).cast("int") - 1).alias("lang"), (1 / rest).alias("probability"),
                     F.get(names, F.col("text_lang")).alias("text_lang"), F.get(names, F.col("declared")).alias("declared"),
                     F.get(names, F.col("suffix")).alias("suffix"), "host")
