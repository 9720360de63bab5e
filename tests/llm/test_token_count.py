import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from draftkit.llm import token_count as T
from draftkit.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, encoding="utf-8").read()
TOK = Tokenizer.from_str(SOURCE)


def want(t):
    return len(TOK.encode(t or "", add_special_tokens=False).ids)


EDGES = [None, "", " ", "  a", "a  b", "a\n\n b", "x\x1c\x85\u2028 y", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "don't I'LL", "½²ªº",
         "日本語 テスト", "é" * 5000, "\x00\x01", "a" * 100_000, "word " * 40_000, "١٢٣ abc", "<|endoftext"]


def test_edges_and_limit(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(EDGES)] + [(1, "", "n")], "doc_id long, text string, n_tokens string")
    got = T.count_tokens(df, PATH, limit=7).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        [(i, len((t or "").encode()), want(t), want(t) > 7) for i, t in enumerate(EDGES)] + [(1, 0, 0, False)])
    assert T.count_tokens(df.where("false"), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeTs 'lv\n\t\x85\xa0é½09!ß\x1f"), st.characters(codec="utf-8")), max_size=30))
def test_counts_match_the_library(t):
    counter = T._counter(SOURCE, WHOLE)
    assert sum(map(counter.__getitem__, T.pre_tokens(t))) == want(t)


WHOLE = T.whole_tokens(SOURCE)


def test_whole_tokens_are_proven():
    assert len(WHOLE) > 40_000
    for t in list(WHOLE)[:2000]:
        assert want(t) == 1


def test_other_tokenizers_are_refused():
    j = json.loads(SOURCE)
    j["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        T._supported(json.dumps(j))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBER", 10)
    c = T.Counter(SOURCE, WHOLE)
    words = [f" qx{i}zj" for i in range(100)]
    assert [c[w] for w in words] == [want(w) for w in words]
    assert len(c) <= len(WHOLE) + 10


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_token_counts"][0](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len(t.encode()), want(t), want(t) > 1024) for i, t in rows.items()} and len(got) == len(rows)
