from collections import Counter

import corpus_pipeline as C
import numpy as np
from pyspark.sql import functions as F
from test_simhash import brute_components

from draftkit.llm import pack_bins as P
from draftkit.llm import quality as Q
from draftkit.llm import simhash as S
from test_decontaminate import holders
from test_pack_bins import check

SF = "/root/testdata/sf0.01"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != "best-fit packing":
            assert out.columns == docs.columns
            got = {r.doc_id: r for r in out.collect()}
            assert all(got[i] == rows[i] for i in got)
            seen[name] = (set(r.doc_id for r in docs.select("doc_id").collect()), set(got))
            docs = C.written(out, "test-stage")
        else:
            packed = out.collect()
    before, after = seen["quality classifier"]
    scores = {r.doc_id: r.predicted for r in Q.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert after == {i for i in before if scores[i] == 1} and len(after) < len(before)
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([i in after for i in known if known[i] == 1]) > 0.97
    before, after = seen["exact dedup"]
    last = {}
    for i in before:
        t = rows[i].text.encode().lower()
        last[t] = max(last.get(t, i), i)
    assert after == set(last.values()) and len(after) < len(before)
    before, after = seen["simhash near-dedup"]
    fp = {i: S.fingerprint(rows[i].text.encode()) for i in before}
    root, least = brute_components(fp.values()), {}
    for i in before:
        least[root[fp[i]]] = min(least.get(root[fp[i]], i), i)
    assert after == set(least.values())
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _ in holders([(i, rows[i].text) for i in before], items)}
    assert after == before - hit and hit
    bins = check(packed, P.CAPACITY)
    assert bins and {r.doc_id for r in packed} == after
    assert sum(r.n_tokens for r in packed) == sum(len(rows[i].text.encode().split()) for i in after)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_pass_every_stage(spark):
    """Nulls in every column, repeated rows, an empty and a very long text,
    and extra columns named like the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    kind = docs.schema
    first = docs.first()
    odd = [(None, None, None, None, None), (None, first.text, None, None, None), (90_001, None, "en", "s", None), (90_002, "", None, None, 0),
           (first.doc_id, first.text, first.lang, first.source, first.n_chars), (90_003, first.text.upper(), "en", None, 1),
           (90_004, "word " * 60_000, "de", "s", 1), (90_005, "plain words that no other row has", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, kind))
    for k, name in enumerate(("_drop", "_md5", "fp", "score", "words", "text_1")):
        docs = docs.withColumn(name, F.lit(k))
    for name, stage in C.STAGES:
        before = Counter(map(tuple, docs.collect()))
        out = stage(spark, docs, SF)
        if name == "best-fit packing":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in before}
            check(out.collect(), P.CAPACITY)
            continue
        assert out.columns == docs.columns
        after = Counter(map(tuple, out.collect()))
        assert not after - before and after, name  # rows stay as they are, or go
        docs = C.written(out, "test-odd")


def test_entry_holds_the_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} >= {"pipeline", "op1_simhash_vantage_point", "op4_quality_random_indexing"}
