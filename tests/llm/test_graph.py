"""Components of small graphs against union-find."""

import random

import pytest

from saleslens.llm.graph import connected_components

from . import brute


def graphs():
    rng = random.Random(5)
    yield "chain", [(i, i + 1) for i in range(40)]
    yield "chain backwards", [(i + 1, i) for i in range(40)]
    yield "star around the largest", [(99, i) for i in range(40)]
    yield "shuffled", [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    yield "one edge", [(-7, 3), (-7, 3), (3, -7), (5, 5), (None, 1)]
    yield "none", []


@pytest.mark.parametrize("name,edges", list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_components(spark, name, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute.components(sorted({x for e in real for x in e}), real)
