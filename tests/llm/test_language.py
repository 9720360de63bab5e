from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pytest

from draftkit.llm import language as L
from draftkit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(pages, training):
    """The same fusion with dictionaries."""
    grams = defaultdict(Counter)
    for lang, text in training:
        if lang and text is not None:
            grams[lang].update(L.trigrams(text).tolist())
    langs = sorted(x for x in grams if grams[x])
    logp = {}
    for x in langs:
        total = sum(grams[x].values()) + L.TRIGRAM * L.BUCKETS
        logp[x] = lambda b, x=x, total=total: log((grams[x][b] + L.TRIGRAM) / total)
    rows = []
    for i, url, markup in pages:
        g = L.trigrams(L.page_text(markup or "")).tolist()
        host, domain, suffix = L.address(url or "")
        c = Counter(g)
        ll = {x: sum(n * logp[x](b) for b, n in c.items()) / len(g) * min(len(g), L.FULL) if g else 0.0 for x in langs}
        top = max(ll.values())
        own = next(x for x in langs if ll[x] == top) if g else None
        kind = lambda v: v if v in langs else "other" if v else ""
        rows.append((i, host, domain, kind(L.declared_language(markup or "")), kind(suffix), own, {x: ll[x] - top for x in langs}))
    n_host, n_domain, n_all = Counter(), Counter(), Counter()
    said = {3: Counter(), 4: Counter()}
    for r in rows:
        n_host[r[1], r[5]] += 1
        n_domain[r[2], r[5]] += 1
        n_all[r[5]] += 1
        for k in said:
            said[k][r[k], r[5]] += 1
    every = {x: (n_all[x] + 1) / sum(n_all[y] + 1 for y in langs) for x in langs}
    out = []
    for r in rows:
        s = {}
        for x in langs:
            less, any_ = float(r[5] == x), float(r[5] is not None)
            t_d, t_h = (sum(c[r[k], y] for y in langs) for c, k in ((n_domain, 2), (n_host, 1)))
            p_d = (n_domain[r[2], x] - less + L.IN_DOMAIN * every[x]) / (t_d - any_ + L.IN_DOMAIN)
            p_h = (n_host[r[1], x] - less + L.IN_HOST * p_d) / (t_h - any_ + L.IN_HOST)
            s[x] = r[6][x] + log(p_h)
            for k in said:
                values = [*langs, "other", ""]
                s[x] += log((said[k][r[k], x] + L.MARK) / (sum(said[k][v, x] for v in values) + L.MARK * len(values)))
        best = max(langs, key=lambda x: s[x])
        out.append((r[0], best, 1 / sum(exp(v - s[best]) for v in s.values()), r[5], r[3], r[4], r[1]))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)


def test_parts():
    assert L.address("https://M.Ex.example.org/de-AT/1?x") == ("m.ex.example.org", "example.org", "de")
    assert L.address("http://[bad") == ("", "", "") and L.address("ex.fr") == ("ex.fr", "ex.fr", "fr") and L.address("") == ("", "", "")
    assert L.declared_language("<HTML class=a LANG='De-at'>") == "de" and L.declared_language("<p lang=fr>") == ""
    assert L.page_text("<script>x</script>a&amp;<b>c</b><!-- d --><nav>e<p>f").split() == ["a&", "c", "e", "f"]
    assert L.page_text("<nav/>a <NAV class=x>b</nav\n>c<header-bar>d</header-bar><footer>e").split() == ["a", "c", "d", "e"]
    assert L.page_text("a<header>b<nav>c</header>d<nav>e</nav><noscript>f").split() == ["a", "d", "f"]
    for tag in ("script", "STYLE"):
        assert L.page_text(f"a<{tag}>b</nav>c").split() == ["a"]
    assert L.page_text("a<!-- b <nav>c</nav>").split() == ["a"]
    many = "<nav>" * 50_000 + "kept"  # one look for what closes them
    assert L.page_text(many).split() == ["kept"]
    assert not len(L.trigrams("")) and not len(L.trigrams(" a ")) and len(L.trigrams("ab")) == 2


def test_edge_rows(spark):
    training = [("en", "the cat sat on the mat with the dog"), ("de", "der hund und die katze sitzen auf der matte"), (None, "x"), ("fr", None), ("", "y")]
    pages = [(1, None, None), (2, "", ""), (3, "http://a.example.de/", "<html lang=de>the cat and the dog"), (4, "http://b.example.com/de/x", "der hund sitzt"),
             (4, "http://b.example.com/de/x", "der hund sitzt"), (None, "http://b.example.com/xx/", "<html lang=qq><p>" + "die katze " * 20_000), (6, "::::", "&&&<<<")]
    t = spark.createDataFrame([(*r, 0) for r in training], "lang string, text string, bucket int")
    p = spark.createDataFrame([(*r, "z", 0) for r in pages], "page_id long, url string, html string, host string, declared int")
    same(L.identify(p, t).collect(), brute(pages, training))
    assert L.identify(p.where("false"), t).count() == 0
    none = L.identify(p, t.where("false")).collect()
    assert len(none) == len(pages) and {r.lang for r in none} == {None}


def test_too_many_languages_are_an_error(spark):
    t = spark.createDataFrame([(f"l{i}", "some text") for i in range(L.MOST_LANGUAGES + 1)], "lang string, text string")
    with pytest.raises(Exception, match="languages"):
        L.fit_text(t)


def test_query_against_brute_force(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    got = QUERIES["op10_language_evidence_fusion"][0](spark, SF).collect()
    same(got, brute(read("pages", "page_id", "url", "html"), read("documents", "lang", "text")))


def test_marks_are_not_needed(spark):
    """Without markup language and path the text and host still decide."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    truth = {r[0]: r[1] for r in pages.selectExpr("page_id", "regexp_extract(html, '<html lang=\"(..)\"', 1)").collect()}
    bare = pages.selectExpr("page_id", "regexp_replace(url, '/../', '/')  AS url", "regexp_replace(html, ' lang=\"..\"', '') AS html")
    got = L.identify(bare, spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert np.mean([r.lang == truth[r.page_id] for r in got]) > 0.97


def test_longer_tag_names_keep_their_text():
    assert L.page_text("<header-bar>a</header-bar><nav-item class=x>b</nav-item><p>c").split() == ["a", "b", "c"]
    assert L.page_text("<nav\nclass=x>a</nav><header>b</header ><script/>c</script>d").split() == ["d"]
