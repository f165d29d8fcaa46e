"""Boosted trees against a plain version that splits one leaf at a time over all rows."""

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslens.operators import boosting
from saleslens.operators.boosting import Model, Params, Task
from saleslens.plans import queries as plans


def plain_bounds(column, max_bins):
    """Values at the ranks ceil(share * n), without the largest."""
    s = sorted(column)
    return sorted({s[max(math.ceil(round(i / max_bins * len(s), 9)) - 1, 0)] for i in range(1, max_bins)} - {s[-1]})


def plain_tree(x, gradient, value, p, ours=None):
    """Steps of all rows by leaf, the leaf with the best gain split next until none is left or the cap is reached; rows outside of ``ours`` follow but don't count."""
    counts = np.ones(len(x), bool) if ours is None else ours

    def best(rows):
        used = rows[counts[rows]]
        top, total = (0.0, None, None), gradient[used].sum()
        for f in range(x.shape[1]):
            n, s = np.bincount(x[used, f], minlength=256).cumsum(), np.bincount(x[used, f], gradient[used], 256).cumsum()
            m = len(used) - n
            with np.errstate(all="ignore"):
                gain = s ** 2 / (n + p.l2) + (total - s) ** 2 / (m + p.l2) - total ** 2 / (len(used) + p.l2)
            gain[(n < max(p.min_rows, 1)) | (m < max(p.min_rows, 1))] = -np.inf
            b = int(np.flatnonzero(gain >= gain.max() - 1e-9 * abs(gain.max()))[0])
            if gain[b] > top[0] * (1 + 1e-9) and gain[b] > 1e-9 * max(1, abs(total)):
                top = (gain[b], rows[x[rows, f] <= b], rows[x[rows, f] > b])
        return top

    leaves = [(np.arange(len(x)), 0)]
    known = [best(leaves[0][0])]
    while len(leaves) < p.max_leaves:
        at = max(range(len(leaves)), key=lambda i: float(f"{known[i][0]:.9e}") if leaves[i][1] < p.max_depth else 0)
        if leaves[at][1] >= p.max_depth or known[at][1] is None:
            break
        depth = leaves[at][1] + 1
        _, left, right = known[at]
        leaves[at:at + 1], known[at:at + 1] = [(left, depth), (right, depth)], [best(left), best(right)]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = value(rows[counts[rows]])
    return out, len(leaves)


def plain_fit(values, y, p, quantile=None, bounds=None):
    bounds = bounds or [plain_bounds(c, p.max_bins) for c in values.T]
    x = np.stack([np.searchsorted(b, c) for b, c in zip(bounds, values.T)], 1)

    def low(r):
        return sorted(r)[max(math.ceil(round(quantile * len(r), 9)) - 1, 0)]

    pred = np.full(len(y), y.mean() if quantile is None else low(y))
    sizes = []
    for _ in range(p.max_iter):
        if quantile is None:
            g = pred - y
            step, n = plain_tree(x, g, lambda r: -p.learning_rate * g[r].sum() / (len(r) + p.l2), p)
        else:
            g = np.where(pred >= y, 1 - quantile, -quantile)
            step, n = plain_tree(x, g, lambda r: p.learning_rate * low(y[r] - pred[r]), p)
        pred = pred + step
        sizes.append(n)
    return pred, sizes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 600
    a, b, c = rng.integers(0, 40, n).astype(float), rng.normal(size=n).round(2), rng.integers(0, 3, n).astype(float)
    y = (3 * (a > 20) * (b > 0) + 5 * (c == 1) + a / 8 + rng.exponential(2, n)).round(3)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y))], "i int, a double, b double, c double, y double").repartition(5)
    return df, np.stack([a, b, c], 1), y


def got(df, model):
    return np.array([r.m for r in boosting.predict(df, {"m": model}, clip_negative=False).orderBy("i").select("m").collect()])


@pytest.mark.parametrize("p", [Params(max_iter=3, max_leaves=63, min_rows=5, max_bins=32), Params(max_iter=2, max_leaves=7, min_rows=20, max_depth=3, learning_rate=0.3, l2=0.0)])
def test_squared_error_is_the_plain_version(spark, rows, p):
    df, x, y = rows
    model = boosting.fit(df, "y", ["a", "b", "c"], [Task("m", F.lit(True))], p)["m"]
    want, sizes = plain_fit(x, y, p)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == sizes and max(sizes) <= p.max_leaves
    assert np.allclose(got(df, model), want, atol=1e-9)
    assert np.allclose(got(df, Model.from_json(model.to_json())), want, atol=1e-9)
    assert sum(model.importance().values()) == pytest.approx(1)


def test_quantiles_side_by_side_are_the_plain_versions(spark, rows):
    df, x, y = rows
    p = boosting.quantile_params(max_iter=4, max_leaves=12, min_rows=4, subsample=1.0, max_bins=64)
    models = boosting.fit(df, "y", ["a", "b", "c"], [Task(f"q{q}", F.lit(True), quantile=q) for q in (0.05, 0.5, 0.95)], p)
    for q in (0.05, 0.5, 0.95):
        assert np.allclose(got(df, models[f"q{q}"]), plain_fit(x, y, p, q)[0], atol=1e-9)


def test_folds_are_fitted_as_if_alone(spark, rows):
    df, x, y = rows
    p = Params(max_iter=3, max_leaves=8, min_rows=5, max_bins=16)
    bounds = boosting.bin_bounds(df, ["a", "b", "c"], 16)
    models = boosting.fit(df, "y", ["a", "b", "c"], [Task("early", F.col("i") < 300), Task("late", F.col("i") >= 200)], p, bounds)
    for name, some in (("early", np.arange(300)), ("late", np.arange(200, 600))):
        want, _ = plain_fit(x[some], y[some], p, bounds=bounds)
        assert np.allclose(got(df, models[name])[some], want, atol=1e-9)


def test_patience_and_held_out_rows(spark):
    assert not boosting.out_of_patience([5.0, 4.0, 4.5], 2, 0.0) and boosting.out_of_patience([5.0, 4.0, 4.5, 4.2], 2, 0.0)
    assert boosting.out_of_patience([5.0, 4.0, 3.99], 1, 0.1) and not boosting.out_of_patience([1.0], 1, 0.0)
    noise = spark.range(400).select(F.col("id").alias("i"), F.rand(1).alias("a"), F.rand(2).alias("y"))
    task = Task("m", F.lit(True), held=F.col("i") % 4 == 0)
    model = boosting.fit(noise, "y", ["a"], [task], Params(max_iter=40, min_rows=1, learning_rate=0.5, patience=3))["m"]
    assert len(model.trees) < 40 and len(model.losses) == len(model.trees) + 1
    best = min(range(len(model.losses)), key=model.losses.__getitem__)
    assert len(model.losses) - 1 - best <= 4
    held = noise.where("i % 4 = 0")
    shown = boosting.predict(held, {"p": model}, clip_negative=False)
    assert shown.agg(F.avg(F.pow(F.col("y") - F.col("p"), 2) / 2)).first()[0] == pytest.approx(model.losses[-1], rel=1e-9)


def test_intervals_cover(spark):
    df = spark.range(6000).select(F.col("id").alias("i"), (F.rand(3) * 10).alias("a"), F.rand(4).alias("u")).withColumn("y", F.col("a") * (1 + F.col("u")))
    models = boosting.fit(df, "y", ["a"], [Task(n, F.col("i") % 2 == 0, quantile=q) for n, q in (("low", 0.05), ("high", 0.95))], boosting.quantile_params(max_iter=20, learning_rate=0.3, max_leaves=12, min_rows=50))
    held = boosting.predict(df.where("i % 2 = 1"), models)
    assert held.agg(F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("int"))).first()[0] == pytest.approx(0.9, abs=0.025)


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 2.0), (3, 0.0, 2.0), (4, 5.0, 8.0), (5, 5.0, 8.0), (6, 1.0, None)], "i int, a double, y double")
    p = Params(max_iter=30, min_rows=1, l2=0.0, learning_rate=1.0)
    model = boosting.fit(df, "y", ["a"], [Task("m", F.lit(True))], p)["m"]
    assert got(df, model).tolist() == [2, 2, 2, 8, 8, 8] and len(model.trees) < 30
    flat = boosting.fit(df.withColumn("y", F.lit(3)), "y", ["a"], [Task("m", F.lit(True))], p)["m"]
    assert flat.trees == [] and set(got(df, flat)) == {3.0}
    with pytest.raises(ValueError):
        boosting.fit(df, "y", ["a"], [Task("m", F.col("i") > 9)], p)
    with pytest.raises(ValueError):
        boosting.fit(df, "y", ["a"], [Task("m", F.lit(True)), Task("m", F.lit(True))], p)


def test_registered_cross_validation_is_the_plain_version(spark, sf_dir):
    """All rows of the folds over the whole panel: bounds are taken from the library, as a sketch may choose others; everything else is plain."""
    _, fitted, oof = plans._leafwise(spark, sf_dir)
    got = oof.orderBy("fold", "date", "store_nbr", "family").toPandas()
    rows = plans._model_rows(spark, sf_dir).fillna(0).orderBy("date", "store_nbr", "family").toPandas()
    p = Params(max_iter=plans._TREES)
    days = sorted(rows["date"].unique())
    for c in fitted.categorical:  # labels are numbered in the order of their texts
        code = {v: i for i, v in enumerate(sorted(map(str, rows.loc[rows["date"] <= days[-1] - timedelta(days=15), c].unique())))}
        rows[c] = rows[c].map(lambda v, code=code: code.get(str(v), -1))
    values = rows[plans._MODEL_FEATURES].astype(float).to_numpy()
    for name, k in (("Fold 1", 2), ("Fold 2", 1)):
        last = days[-1]
        train = (rows["date"] <= last - timedelta(days=15 * k)).to_numpy()
        held = ((rows["date"] > last - timedelta(days=15 * k)) & (rows["date"] <= last - timedelta(days=15 * (k - 1)))).to_numpy()
        model = fitted.models[name]
        assert len(model.trees) == plans._TREES and all(sum(f < 0 for f in t.feature) == 63 for t in model.trees)
        y = rows["sales"].to_numpy(float)
        want = plain_predict(values, y, train, p, model.bounds)[held]
        assert np.allclose(got.loc[got["fold"] == name, "pred"], np.maximum(want, 0), atol=1e-6)
        assert np.allclose(got.loc[got["fold"] == name, "sales"], y[held])


def plain_predict(values, y, train, p, bounds):
    """Predictions for all rows of trees fitted to some."""
    x = np.stack([np.searchsorted(b, c) for b, c in zip(bounds, values.T)], 1)
    pred = np.full(len(y), y[train].mean())
    for _ in range(p.max_iter):
        g = pred - y
        pred = pred + plain_tree(x, g, lambda r: -p.learning_rate * g[r].sum() / (len(r) + p.l2), p, train)[0]
    return pred
