"""Near copies of the pipeline against exact Jaccard similarity, pair by pair."""

import random

import corpus_pipeline
from saleslens.llm import neardup

from . import brute


def shingles(text):
    w = brute.words(brute.lower_ascii(text or ""))
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def kept(docs):
    """Ids of the rows (id, text) that stay: the smallest of each component."""
    sets = [(i, shingles(t)) for i, t in docs]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x == y or 10 * len(x & y) >= 8 * len(x | y)]
    own = brute.components([i for i, _ in docs], links)
    return sorted(i for i, c in own.items() if i == c)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect())
    assert got == kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_similar_pairs_meet_and_others_stay(spark):
    rng, docs = random.Random(7), []
    for i in range(150):  # single words replaced, 5 shingles each: similarities of about 0.65 to 0.97
        words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(10, 190, 10), 1 + i % 8):
            other[at] = f"x{at}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other).upper())]
    want = kept(docs)
    assert 150 < len(want) < 300
    assert run(spark, docs) == want


def test_exact_limit_chain_and_defined_cases(spark):
    base = [f"b{i}" for i in range(40)]  # 36 shingles; the first 4 words replaced: 32 of 40, exactly 0.8; 5 replaced: 31 of 41
    four, five = [*(f"y{i}" for i in range(4)), *base[4:]], [*(f"z{i}" for i in range(5)), *base[5:]]
    assert len(shingles(" ".join(base)) & shingles(" ".join(four))) * 10 == 8 * len(shingles(" ".join(base)) | shingles(" ".join(four)))
    docs = [(9, " ".join(base)), (3, " ".join(four)), (11, " ".join(five)), (20, None), (21, ""), (22, "One two"), (23, "one  two"), (24, "one")]
    assert run(spark, docs) == kept(docs) == [3, 11, 20, 22, 24]
    assert run(spark, []) == []


def chain(n, first):
    """Sets of which neighbours share 90 of 110 members, the next ones 80 of 120."""
    return [neardup.np.arange(first + i, first + i + 100, dtype=neardup.np.uint64) for i in range(0, 10 * n, 10)]


def test_piece_is_linked_whole():
    links = neardup._forest(list(range(60)), chain(60, 0))
    assert len(links) == 59 and {abs(x - y) for x, y in links} == {1}


def test_bucket_of_many_pieces_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PIECE", 8)
    sets = [*chain(60, 0), *chain(40, 10**6), *(chain(1, 10**7 * (i + 1))[0] for i in range(20))]
    rows = spark.createDataFrame([(g, bytearray(s.tobytes())) for g, s in enumerate(sets)], "g long, set binary")
    buckets = {1: range(120), 2: range(100, 120), 3: (5, 6), 4: (5, 7)}
    once = spark.createDataFrame([(k, len(b), min(b)) for k, b in buckets.items()], "k long, n long, m long")
    members = spark.createDataFrame([(k, len(b), min(b), g) for k, b in buckets.items() for g in b], "k long, n long, m long, g long")
    got = {}
    for r in neardup._roots(members, once, rows).collect():
        got.setdefault(r.root, set()).add(r.g)
    assert sum(map(len, got.values())) == 100 and sorted(map(sorted, got.values())) == [list(range(60)), list(range(60, 100))]
