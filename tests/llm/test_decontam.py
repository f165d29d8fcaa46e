"""Contamination against laying every item along every document, and the completeness of the masks."""

import random

import pytest

from saleslens.llm import decontam

from . import brute


def found(df):
    return {(r.doc_id, r.item_id): (r.similarity, r.first_token) for r in df.collect()}


def test_masks_are_complete():
    for n in range(1, 14):
        masks = decontam.MASKS[max(c for c in decontam.MASKS if c <= n)]
        assert decontam.complete(masks, n, decontam.substitutions(n, decontam.MIN_SIMILARITY))
    assert not decontam.complete(((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8)), 9, 1)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_whole_table(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", most)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(decontam.contamination(docs, items)) == want
    assert want


@pytest.mark.parametrize("seed", [1, 2])
def test_short_items_and_substitutions(spark, seed):
    """Items of 1 to 20 tokens of few different words, in documents with and without substitutions, at every place."""
    rng = random.Random(seed)
    items = [(n, " ".join(f"i{n}x{rng.randrange(40)}" for _ in range(n))) for n in range(1, 21)]
    docs = [(0, None), (1, "")]
    for n, text in items:
        for subs in range(4):
            t = text.split()
            for at in rng.sample(range(n), min(subs, n)):
                t[at] = f"y{rng.randrange(99)}"
            docs.append((len(docs), " ".join([*(f"z{rng.randrange(9)}" for _ in range(rng.randrange(4))), *t, *(f"z{rng.randrange(9)}" for _ in range(rng.randrange(4)))])))
    want = brute.contaminated(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(decontam.contamination(d, b)) == want
    assert found(decontam.contamination(d, b, min_tokens=5)) == {k: v for k, v in want.items() if k[1] >= 5}
    assert {k[1] for k in want} == set(range(1, 21))


def test_defined_cases(spark):
    item = [f"t{i}" for i in range(30)]
    two = list(item[4:17])
    two[3], two[8] = "x", "y"
    docs = [(1, "pre " + " ".join(item[4:17]) + " post"), (2, " ".join(two)), (3, " ".join(item[4:12])), (4, None), (5, ""), (6, " ".join(item).upper() + "!"), (6, " ".join(item)), (None, " ".join(item)),
            (7, " ".join(f"{a} z" for a in item)), (8, "s0 s1 s2 s3 s4 s5 s6 s7 s8"), (9, "w " * 60_000 + " ".join(item) + " w" * 60_000)]
    bench = [("i1", " ".join(item)), ("i2", " ".join(item)), ("i3", None), ("i4", ""), ("i5", "s0 s1 s2 s3 s4 s5 s6 s7 s8"), ("i6", "s0 s1 s2"), (None, "s7 s8"), ("i6", "s1 s2")]
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, item string, H int")
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id string, text string, k int")
    got = found(decontam.contamination(d, b))
    assert set(got) == {*((n, i) for n in (1, 2, 6, None, 9) for i in ("i1", "i2")), (8, "i5"), (8, "i6"), (8, None)}
    assert got[9, "i1"] == (1.0, 60_000) and got[2, "i2"][0] == 11 / 13
    assert decontam.contamination(d.limit(0), b).count() == decontam.contamination(d, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        decontam.contamination(d, b, min_similarity=0.5)
