"""Exact percentiles by brackets against sorting, and the exploration that uses them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslens.operators import eda, selection

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [selection.ACCURACY, 100, 20])
def test_groups_of_many_kinds(spark, accuracy):
    pick = random.Random(1)
    groups = {"one": [5.0], "two": [2.0, 9.0], "ties": [1.0] * 400 + [2.0] * 400, "normal": [pick.gauss(0, 1) for _ in range(3000)], "few values": [float(pick.randrange(4)) for _ in range(2500)],
              "skewed": [pick.expovariate(1) ** 4 for _ in range(1501)], None: [float(i) for i in range(999)], "signs": [-0.5, 0.0, 0.5] * 333}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("nothing", None)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: (r.n, r.q) for r in selection.exact_percentiles(df, "v", SHARES, ["g"], accuracy).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == len(values) and got[g][1] == pytest.approx(np.percentile(values, [100 * s for s in SHARES]).tolist(), rel=1e-11, abs=1e-12), g
    every = selection.exact_percentiles(df, "v", SHARES, accuracy=accuracy).first()
    assert every.q == pytest.approx(np.percentile([v for _, v in rows if v is not None], [100 * s for s in SHARES]).tolist(), rel=1e-11, abs=1e-12)
    same = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).where("q is not null").collect()
    assert all(got[r.g][1] == r.q for r in same)  # to the last bit what Spark's own gives
    assert selection.exact_percentiles(df.limit(0), "v", SHARES, ["g"], accuracy).count() == selection.exact_percentiles(df.limit(0), "v", SHARES, accuracy=accuracy).count() == 0


def test_no_group_is_gathered(spark):
    """Neither a buffer of all values nor a window over more than the brackets: rows after the counting pass are few."""
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    plan = selection.exact_percentiles(df, "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "median(" not in plan
    assert selection.exact_percentiles(df, "v", [0.5], accuracy=1000).first().q[0] == df.agg(F.median("v")).first()[0]


def test_exploration_keeps_its_rows(spark):
    rows = [(f"F{i % 7}", float((i * 37) % 101)) for i in range(2000)] + [("F9", None)]
    df = spark.createDataFrame(rows, "family string, sales double")
    median = {r.family: r.m for r in df.groupBy("family").agg(F.bround(F.median("sales"), 2).alias("m")).collect()}
    assert {r.family: r.median for r in eda.family_distribution(df).collect()} == median
    assert eda.sales_distribution(df).first().median == np.median([v for _, v in rows if v is not None])
    box = eda.family_boxplot(df, 3).collect()
    assert len(box) == 3 and all([r.q25, r.q50, r.q75] == np.percentile([v for f, v in rows if f == r.family], [25, 50, 75]).tolist() for r in box)
    d = eda.describe(df, "sales").first()
    assert (d["count"], d.min, d.max) == (2000, 0.0, 100.0) and [d.q25, d.q50, d.q75] == np.percentile([v for _, v in rows if v is not None], [25, 50, 75]).tolist()
    assert eda.sales_distribution(df.limit(0)).first().median is None and eda.describe(df.limit(0), "sales").first().q50 is None
