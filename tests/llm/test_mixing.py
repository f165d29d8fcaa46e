"""Mixing against the plain definition, and defined cases."""

from pyspark.sql import functions as F

from saleslens.llm import mixing

from . import brute


def test_against_definition(spark):
    rows = [(i, ("a", "b", None, "d", "e")[min(i % 11, 4)], (i * 7919) % 50 + 1, (2.0, 0.5, 1.0)[i % 3]) for i in range(800)]
    df = spark.createDataFrame([(i, s, " ".join(["w"] * n), q) for i, s, n, q in rows], "doc_id long, source string, text string, q double")
    got = {r.doc_id: r.taken for r in mixing.mix(df, quality=F.col("q")).collect()}
    assert got == brute.mixed(rows)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), quality=F.col("q")).collect()}
    assert got == again


def test_targets_and_caps(spark):
    rows = mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 5)], "source string, source_size long")).collect()
    got = {r.source: r.target for r in rows}
    assert got["a"] == 30.0 and got[None] == 15.0 and got["b"] == 1015.0 - 45.0


def test_defined_cases(spark):
    rows = [(1, "a", None, None), (2, "a", "", 1), (3, "a", "x y", -1), (3, "a", "x y", 0), (None, None, "z", 2), (4, None, None, 2), (5, "", "p q r", None)]
    df = spark.createDataFrame([(*r, "t", 0, 1, 2, 3, 4) for r in rows], "doc_id long, source string, text string, q long, Taken string, target int, epochs int, Rest int, bucket int, size int")
    got = mixing.mix(df, quality=F.col("q").cast("double")).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert {(r.doc_id, r.taken) for r in got if r.size == 0} == {(1, 0), (2, 0), (4, 0)}
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(df.where("doc_id = 1")).collect())


def test_texts_are_joined_to_decisions(spark):
    rows = [(i, ("a", "b", None)[i % 3], "w " * (i % 40 + 1), "x") for i in range(300)] + [(None, "a", None, "y"), (None, "a", "null id", "y"), (7, "b", "other text of 7", "z"), (8, "c", "v " * 40_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, Target string")
    best = spark.createDataFrame([(i, float(i % 3 + 1)) for i in range(200)], "doc_id long, quality double")
    got = mixing.mix_texts(df, best).collect()
    assert len(got) == len(rows) and "Target" not in mixing.mix_texts(df, best).columns
    size = {(r[0], r[2]): len(brute.words(r[2])) for r in rows}
    want = brute.mixed([(i, s, size[i, t], float(i % 3 + 1) if i is not None and i < 200 else 1.0) for i, s, t, _ in rows if i not in (None, 7)])
    assert all(r.size == size[r.doc_id, r.text] and 0 <= r.taken <= 3 * r.size for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(taken) - target) <= 60 or source == "c" for (source, target), taken in by_source.items()) and want
    assert mixing.mix_texts(df.limit(0), best).count() == 0
    twice = mixing.mix_texts(df.where("doc_id < 20").unionAll(df.where("doc_id < 20")), best).collect()
    assert len(twice) == 44 and all(r.taken <= 3 * r.size for r in twice)


def test_low_qualities_spread_over_buckets(spark):
    """With the smallest quality, keys would all be far out; buckets still hold few documents each."""
    keys = spark.range(20_000).select(mixing.exponential_key(F.col("id"), F.lit(0.0)).alias("k"))
    most = keys.groupBy(F.floor(F.ln("k") * mixing.STEPS)).count().agg(F.max("count")).first()[0]
    assert most <= 40
