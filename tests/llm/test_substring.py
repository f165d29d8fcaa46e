"""Removed passages against the definition, over the whole small table and defined cases."""

import hashlib
import random

import pytest

from saleslens.llm import queries, substring

from . import brute


def result(df):
    return sorted(((r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=repr)


def expected(docs):
    return sorted(brute.without_passages(docs), key=repr)


@pytest.fixture(params=["as set", "every shared key hot"])
def hot(request, monkeypatch):
    """With ``max`` patched in the module, two documents make a key hot, so that all routes of hot keys are taken."""
    if request.param != "as set":
        monkeypatch.setattr(substring, "max", lambda *x: 2.0 if x[0] == 64.0 else max(*x), raising=False)


def test_whole_table(spark, sf_dir, hot):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op4_substring(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    want = expected(docs)
    assert got == want
    assert any(n for _, _, n, _ in want)


def test_defined_cases(spark, hot):
    a = [f"a{i}" for i in range(40)]
    docs = [(3, " ".join(a)), (4, "x " + " ".join(a[5:30]) + "\ty z"), (4, " ".join(a[:20])), (9, " ".join(["same"] * 500)), (10, " ".join(["same"] * 13)), (11, " ".join(["same"] * 12)),
            (None, " ".join(a)), (12, None), (13, ""), (14, " \n"), (15, " ".join(a[:13]) + " q " + " ".join(a[20:33]) + " " + " ".join(a[27:40])), (1, " ".join(a[10:24])),
            (20, " ".join(f"w{i}" for i in range(60_000))), (21, " ".join(f"w{i}" for i in range(30_000, 90_000)))]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, SPANS int, kept string")
    assert result(substring.factors(df)) == expected(docs)
    assert substring.factors(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_boundaries(spark, hot, seed):
    """Few words and pasted passages: many runs of one seed, and windows across the ends of factors of several documents."""
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            if texts and rng.random() < 0.6:
                w = rng.choice(texts)
                at = rng.randrange(len(w))
                parts += w[at:at + rng.randrange(5, 40)]
            else:
                parts += [rng.choice("abc") for _ in range(rng.randrange(3, 30))]
        texts.append(parts)
    docs = [(rng.randrange(100), " ".join(w)) for w in texts]
    assert result(substring.factors(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)


def test_greedy_takes_the_longest_and_goes_on_across_its_end():
    word = [bytes([i]) * 8 for i in range(30)]
    index = {b"".join(word[i:j]) for a, b in ((0, 6), (3, 10)) for i in range(a, b) for j in range(i + 3, b + 1)}
    assert list(substring.greedy(b"".join(word[:12]), index, 3)) == [(0, 6), (4, 10)]
