"""Fingerprints and components against pairwise comparison."""

import pytest

from saleslens.llm import queries, simhash

from . import brute


def result(df):
    return sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in df.collect())


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, sf_dir).collect())
    want = sorted(brute.simhash_components(docs))
    assert got == want
    assert any(i != c for i, _, c in want)


@pytest.mark.parametrize("most", [2, 4096])
def test_finer_buckets_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_BUCKET", most)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        text = list(base)
        text[(i * 37) % 300] = f"x{i % 20}"
        docs.append((i, " ".join(text)))
    docs += [(100 + i, f"other {i} text {i * i} of its own {i ** 3}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(simhash.near_duplicates(df)) == sorted(brute.simhash_components(docs))


def test_defined_cases(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = [(5, None), (6, ""), (7, " \t\n"), (8, "A b\x0bC"), (8, "a B c"), (9, "a b c"), (10, "Été été"), (11, long_text), (12, long_text), (13, "one"), (14, "one two")]
    df = spark.createDataFrame([(*d, "x", 1, None) for d in docs], "doc_id long, text string, FP string, component_id int, root string")
    assert result(simhash.near_duplicates(df)) == sorted(brute.simhash_components(docs))
    nulls = simhash.near_duplicates(spark.createDataFrame([(None, "q r s t"), (3, "q r s t"), (None, "all by itself")], "doc_id long, text string")).collect()
    assert sorted(nulls, key=str) and {(r.doc_id, r.component_id) for r in nulls} == {(None, 3), (3, 3), (None, None)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
