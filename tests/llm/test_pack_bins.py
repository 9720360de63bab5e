import random
from collections import Counter, defaultdict

from draftkit.llm import pack_bins as P
from draftkit.llm.queries import QUERIES


def slow(items, capacity, limit):
    """The tightest compatible bin, by looking at all of them."""
    bins, out = [], []
    for n, s, c in items:
        fits = [(capacity - sum(x[0] for x in b) - n, i) for i, b in enumerate(bins)
                if capacity - sum(x[0] for x in b) >= n and all(x[2] != c for x in b) and sum(x[1] == s for x in b) < limit]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((i, sum(x[0] for x in bins[i])))
        bins[i].append((n, s, c))
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        items = sorted(((rng.randint(1, 100), rng.choice(["a", "a", "b", None]), rng.randrange(12)) for _ in range(rng.randint(0, 120))), key=lambda x: -x[0])
        assert P.best_fit(items, 100, 2) == slow(items, 100, 2)


def check(rows, capacity, limit=P.SOURCE_LIMIT):
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is None:
            assert r.n_tokens == 0
        else:
            bins[r.bin_id].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert at <= capacity
        assert max(Counter(r.cluster for r in b).values()) == 1
        assert max(Counter(r.source for r in b).values()) <= limit
    return bins


def test_edge_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a b c", None), (3, "a b c", None), (4, "A  b\tc", "t"), (5, " ".join(["w"] * 25), "s"), (None, "x y", "s"),
            (6, " ".join(["w"] * 20), "s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, piece int, bin_id int")
    got = P.pack_documents(df, 10).collect()
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == Counter(
        [(1, 0, 0), (2, 0, 0), (3, 0, 3), (3, 0, 3), (4, 0, 3), (5, 0, 10), (5, 1, 10), (5, 2, 5), (None, 0, 2), (6, 0, 10), (6, 1, 10)])
    check(got, 10)
    assert P.pack_documents(df.where("false"), 10).count() == 0


def test_query_keeps_all_words_and_is_tight(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: len(r.text.encode().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_conflict_best_fit_packing"][0](spark, sf).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert dict(total) == docs
    bins = check(got, P.CAPACITY)
    assert sum(docs.values()) > 0.9 * P.CAPACITY * len(bins)


def test_segments_are_the_same_for_any_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = P.windows(df)
    a = sorted(map(tuple, P.pack(items, segment=100).where("n_tokens > 0").collect()))
    b = sorted(map(tuple, P.pack(items.repartition(7), segment=100).where("n_tokens > 0").collect()))
    assert a == b and any(r[2] == P.CAPACITY for r in a)


def test_equal_rows_spread_over_the_segments(spark):
    """A group of equal rows, and one of copies without a doc_id from many
    sources, are not one segment each."""
    rows = [(7, 0, 9, "a", 5)] * 3000 + [(None, 0, 9, f"s{i}", 6) for i in range(3000)] + [(i, 0, 1 + i % 90, f"s{i % 50}", 100 + i) for i in range(6000)]
    items = spark.createDataFrame(rows, "doc_id long, piece long, n_tokens long, source string, cluster long")
    got = P.pack(items, 100, segment=300).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    check(got, 100)
    assert max(Counter(r.bin_id >> 32 for r in got).values()) < 1000
    again = P.pack(items.repartition(7), 100, segment=300).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_token_lengths_and_fill(spark):
    import public_tokenizers

    from draftkit.llm.queries import TOKENIZER
    from draftkit.llm.token_count import count_tokens
    path = public_tokenizers.path(TOKENIZER)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = P.pack_documents(docs, 512, tokenizer_path=path)
    want = {r.doc_id: r.n_tokens for r in count_tokens(docs, path).collect()}
    got, rows = Counter(), packed.collect()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert dict(got) == want
    bins = check(rows, 512)
    f = P.fill(packed, 512).first()
    assert (f.bins, f.n_tokens) == (len(bins), sum(want.values())) and f.fill == f.n_tokens / (512 * f.bins) > 0.9
    assert tuple(P.fill(packed.where("false")).first()) == (0, 0, None)
