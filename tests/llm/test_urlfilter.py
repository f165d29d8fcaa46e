"""Rules, the list behind the Bloom filter, and defined cases."""

import pytest
from pyspark.sql import functions as F

from saleslens.llm import bloom, urlfilter
from saleslens.llm.queries import RULES


@pytest.mark.parametrize("per_block", [1, 32, 10_000])
def test_list_is_exact(spark, monkeypatch, per_block):
    monkeypatch.setattr(bloom, "PER_BLOCK", per_block)
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.org/p{i}?b=2&a=1") for i in range(3000)], "page_id long, url string")
    listed = spark.createDataFrame([(f"HTTPS://H{i % 50}.org:443/p{i}/?a=1&utm_x=9&b=2#f",) for i in range(0, 3000, 3)] + [(None,), ("nothing",)], "url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, listed, []).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(3000)}


@pytest.mark.parametrize("per_block", [32, 512])
def test_false_positives_reach_the_exact_join_only(spark, monkeypatch, per_block):
    """Of 20,000 URLs that aren't listed, the filter lets some through; all end as allowed.  Repeated rows are judged alike."""
    monkeypatch.setattr(bloom, "PER_BLOCK", per_block)
    listed = spark.range(20_000).select(F.concat(F.lit("http://h.org/l"), "id").alias("url"))
    pages = spark.range(20_000).select("id", F.concat(F.lit("http://h.org/p"), "id").alias("url"))
    pages = pages.unionByName(pages.where("id < 10")).unionByName(listed.select(F.lit(-1).alias("id"), "url"))
    table, blocks = bloom.build_filter(listed.select(urlfilter.canonical(F.col("url")).alias("c")), "c")
    probe = pages.where("id >= 0").select(urlfilter.canonical(F.col("url")).alias("c"))
    false = bloom.flagged(probe, "c", table, blocks).where("__maybe").count()
    assert 0 < false < (2000 if per_block == 32 else 20_010)
    got = urlfilter.judge(pages, listed, []).groupBy((F.col("id") < 0).alias("listed"), "verdict").count().collect()
    assert {(r.listed, r.verdict, r["count"]) for r in got} == {(False, "allow", 20_010), (True, "block", 20_000)}


def test_long_url(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 1_000_000), (2, "x" * 1_000_000), (3, "http://a.org/?" + "b=1&" * 100_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, df.where("page_id = 3"), RULES).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "allow"), 3: (None, "block")}


def test_rules_and_defined_cases(spark):
    cases = [("http://example.com/en/a", "example.com/en/", "block"), ("http://www.Example.com/en/", "www.example.com/en/", "allow"), ("http://x.www.example.com/en/q?r", "www.example.com/en/", "allow"),
             ("http://example.com/fr", "com/", "allow"), ("http://notexample.com/en/", "com/", "allow"), ("http://a.net/es/", "net/es/", "block"), ("http://a.net/de/", None, "allow"), ("http://com", None, "allow"),
             (None, None, "allow"), ("", None, "allow"), ("no scheme/en/", None, "allow"), ("http://", None, "allow"), ("http://net?/es/", None, "allow"), ("x://a.net/fr/://b.com/", "net/fr/", "block")]
    df = spark.createDataFrame([(i, u, "v", 1, 2, 3) for i, (u, _, _) in enumerate(cases)], "page_id long, url string, Verdict string, block int, w0 int, canonical int")
    empty = spark.createDataFrame([], "url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, empty, RULES).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert {(r.host, r.path) for r in urlfilter.judge(df.where("page_id in (8, 9, 10)"), empty, RULES).collect()} == {("", "")}
    assert urlfilter.judge(df.limit(0), empty, RULES).count() == 0
