"""Long series and global windows against plain loops."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saleslens.operators import temporal

DAY = date(2000, 1, 1)


@pytest.fixture
def many_pieces(spark):
    """Exchanges aren't coalesced, so small tables lie in several pieces."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def series_rows(lengths, nulls=0.1, seed=1):
    pick = random.Random(seed)
    return [(s, f"f{s % 2}" if s else None, i, None if pick.random() < nulls else round(pick.gauss(10, 5), 3)) for s, n in enumerate(lengths) for i in range(n)]


def plain_ewm(values, span):
    """Weights b^age of the rows before, nulls skipped, as a recurrence."""
    b, n, d, out = 1 - 2 / (span + 1), 0.0, 0.0, []
    for v in values:
        out.append(n / d if d else None)
        n, d = n * b + (v if v is not None else 0), d * b + (v is not None)
    return out


def compared(got, rows, spans):
    by = {}
    for s, _, _, v in rows:
        by.setdefault(s, []).append(v)
    for s, values in by.items():
        ours = sorted((r for r in got if r.s == s), key=lambda r: r.i)
        for span in spans:
            for r, w in zip(ours, plain_ewm(values, span), strict=True):
                x = r[f"v_ewm_{span}"]
                assert (x is None) == (w is None) and (w is None or math.isclose(x, w, rel_tol=1e-9, abs_tol=1e-9)), (s, r.i, span)


def test_exponential_means_of_any_length(spark, many_pieces):
    rows = series_rows([1, 2, 300, 5000, 257, 256])
    df = spark.createDataFrame(rows, "s int, f string, i int, v double").repartition(5)
    got = temporal.add_ewm_long(df, "v", (2, 7, 28, 365), ("s", "f"), "i")
    assert got.columns == ["s", "f", "i", "v", "v_ewm_2", "v_ewm_7", "v_ewm_28", "v_ewm_365"]
    compared(got.collect(), rows, (2, 7, 28, 365))
    short = [r for r in rows if r[0] != 3]
    small = spark.createDataFrame(short, "s int, f string, i int, v double")
    compared(temporal.add_ewm(small, "v", (7, 28), ("s", "f"), "i").collect(), short, (7, 28))


def test_a_series_of_100_000_rows(spark):
    """Chosen by the longest series; no task has a whole series: the rows lie in several pieces."""
    rows = [(1, "f", i, None if i % 97 == 0 or 40_000 < i < 42_000 else float((i * 7919) % 1009)) for i in range(100_000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "f", "i", "v"])).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = temporal.add_ewm(df, "v", (7, 28), ("s", "f"), "i").collect()
        assert temporal.pieced(df, ("s", "f"), "i").select("__piece").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    compared(got, [tuple(r) for r in rows], (7, 28))


def plain_across(rows, window):
    """Rolling over one list of all series in order, of the value before in the same series."""
    before = [rows[i - 1][3] if i and rows[i - 1][:2] == rows[i][:2] else None for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        some = [v for v in before[max(0, i + 1 - window):i + 1] if v is not None]
        out.append((np.mean(some) if some else None, np.std(some, ddof=1) if len(some) > 1 else None, min(some, default=None), max(some, default=None)))
    return out


@pytest.mark.parametrize("lengths", [[40, 3, 1, 1, 90, 7], [5, 2]])
def test_rolling_across_series(spark, many_pieces, lengths):
    rows = sorted(((str(r[0]), str(r[1]), *r[2:]) for r in series_rows(lengths)), key=lambda r: r[:3])
    rows = [(s, f, DAY + timedelta(days=i), v) for s, f, i, v in rows]
    df = spark.createDataFrame(rows, "s string, f string, d date, v double").repartition(4)
    got = temporal.add_rolling(df, "v", (3, 28), ("s", "f"), "d", across=True)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    ours = sorted(got.collect(), key=lambda r: r[:3])
    assert [tuple(r[:4]) for r in ours] == rows
    for n in (3, 28):
        for r, w in zip(ours, plain_across(rows, n), strict=True):
            x = [r[f"v_rolling_{k}_{n}"] for k in ("mean", "std", "min", "max")]
            assert all((a is None) == (b is None) and (b is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(x, w, strict=True)), (r, w)
    assert temporal.add_rolling(df.limit(0), "v", (3,), ("s", "f"), "d", across=True).count() == 0
