"""Label codes, sampling, early stopping, the last fit, intervals and the dense reconciliation on small inputs."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from saleslens.operators import boosting, business, features, hierarchy, models
from saleslens.plans import runs
from saleslens.sources import readers, writers

DAY = date(2017, 6, 1)
TREES = models.gbt_params(maxIter=4, maxDepth=3, minInstancesPerNode=1)


def codes(model, df, column):
    """The code of each row of ``df`` as the fitted pipeline gives it."""
    rows = df.withColumn(f"{column}__text", F.col(column).cast("string"))
    return [r[f"{column}__code"] for r in PipelineModel(model.stages[:-2]).transform(rows).orderBy("i").collect()]


def test_labels_are_coded_in_string_order_and_unseen_ones_minus_one(spark):
    train = spark.createDataFrame([(i, k, float(i % 5), float(k)) for i in range(60) for k in (1, 10, 2)], "i int, k int, x double, sales double")
    model = models.train_gbt(train, features=["k", "x"], categorical=["k"], params=TREES)
    asked = spark.createDataFrame([(0, 1), (1, 10), (2, 2), (3, 7), (4, None)], "i int, k int")
    assert codes(model, asked, "k") == [0, 1, 2, -1, -1]
    got = models.predict_gbt(model, asked.withColumn("x", F.lit(1.0)))
    assert got.columns == ["i", "k", "x", "pred"] and got.where("pred is null").count() == 0


def test_many_labels_are_no_obstacle(spark):
    rows = spark.range(600).select((F.col("id") % 200).alias("k"), (F.col("id") % 7).cast("double").alias("sales"))
    model = models.train_gbt(rows, features=["k"], categorical=["k"], params=TREES)
    assert models.predict_gbt(model, rows).where("pred is null").count() == 0


def test_samples_are_without_replacement_and_repeatable(spark):
    rows = spark.range(1000).repartition(7)
    some = [r.id for r in models.sample_rows(rows, 100).collect()]
    assert len(set(some)) == 100 and sorted(some) == sorted(r.id for r in models.sample_rows(rows.repartition(3), 100).collect())
    assert set(some) != {r.id for r in models.sample_rows(rows, 100, seed=1).collect()}
    assert models.sample_rows(rows, 5000).count() == 1000 and models.sample_rows(rows.limit(0), 5).count() == 0


def test_boosting_stops_on_held_out_rows(spark):
    noise = spark.range(400).select(F.rand(1).alias("x"), F.rand(2).alias("sales"))
    params = models.gbt_params(maxIter=30, maxDepth=3, minInstancesPerNode=1, stepSize=0.5)
    full = models.train_gbt(noise, features=["x"], categorical=[], params=params)
    early = models.train_gbt(noise, features=["x"], categorical=[], params=params, early_fraction=0.3)
    assert full.stages[-1].getNumTrees == 30 and early.stages[-1].getNumTrees < 30


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A features table of two stores and two families, 80 days up to 2017-08-19."""
    rows = [(DAY + timedelta(days=i), s, f, float(10 * s + (i % 7) + (5 if f == "B" else 0)), i % 7) for i in range(80) for s in (1, 2) for f in ("A", "B")]
    base = tmp_path_factory.mktemp("runs")
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, weekday int")
    writers.write_parquet(df, f"file://{base}/processed/train_features.parquet", sort_by=("store_nbr", "family", "date"))
    return f"file://{base}"


def test_final_model_is_stored_and_sees_no_later_day(spark, folder, monkeypatch):
    seen = {}
    fit = models.train_gbt
    monkeypatch.setattr(models, "train_gbt", lambda rows, **kw: seen.update(rows=rows, **kw) or fit(rows, **kw))
    model = runs.train_final_model(spark, f"{folder}/processed", f"{folder}/models", features=["store_nbr", "family", "weekday"], params=TREES)
    assert seen["rows"].agg(F.max("date")).first()[0] == date(2017, 8, 15) and seen["rows"].count() == 76 * 4 and seen["early_fraction"] == 0.1
    rows = readers.load_parquet(spark, f"{folder}/processed/train_features.parquet")
    again = writers.load_model(f"{folder}/models/model_final")
    a, b = (models.predict_gbt(m, rows).select("date", "store_nbr", "family", "pred") for m in (model, again))
    assert a.exceptAll(b).isEmpty() and a.count() == rows.count()


def test_intervals_are_written_and_read_back(spark, folder):
    coverage = runs.predict_intervals(spark, f"{folder}/processed", f"{folder}/predictions", f"{folder}/models", features=["store_nbr", "family", "weekday"], params=TREES).first()
    got = readers.load_quantile_predictions(spark, f"{folder}/predictions")
    assert got.columns == ["date", "store_nbr", "family", "unique_id", "sales", "pred", "pred_q05", "pred_q50", "pred_q95"]
    assert got.count() == 15 * 4 and got.agg(F.min("date"), F.max("date")).first()[:] == (date(2017, 8, 1), date(2017, 8, 15))
    assert got.where("not (0 <= pred_q05 and pred_q05 <= pred_q50 and pred_q50 <= pred_q95)").isEmpty()
    inside = got.where("sales between pred_q05 and pred_q95").count()
    assert coverage.coverage_pct == pytest.approx(100 * inside / 60)
    assert readers.load_quantile_predictions(spark, f"{folder}/nowhere") is None


def test_residual_quantiles_by_family(spark):
    rows = spark.range(101).select(F.lit("A").alias("family"), F.col("id").cast("double").alias("sales"), F.lit(0.0).alias("pred"))
    assert models.fit_residual_quantiles(rows).first()[1:] == (5.0, 50.0, 95.0)


def test_dense_reconciliation_is_the_closed_form(spark):
    stores, families, rng = ["1", "2"], ["A", "B", "C"], np.random.default_rng(0)
    order = ["Total", *[f"Store_{s}" for s in stores], *[f"Family_{f}" for f in families], *[f"{s}_{f}" for s in stores for f in families]]
    days = [DAY + timedelta(days=i) for i in range(40)]
    errors, y = rng.normal(size=(40, len(order))), rng.uniform(5, 50, size=(2, len(order)))
    level = {n: n.split("_")[0] if n.split("_")[0] in ("Total", "Store", "Family") else "Bottom" for n in order}
    schema = "date date, level string, series_id string, value double"
    residuals = spark.createDataFrame([(d, level[n], n, float(v)) for d, row in zip(days, errors) for n, v in zip(order, row)], schema).repartition(5)
    base = spark.createDataFrame([(d, level[n], n, float(v)) for d, row in zip(days, y) for n, v in zip(order, row)], schema)
    got = {(r.date, r.store_nbr, r.family): r.reconciled for r in hierarchy.mint_shrink(base, residuals).collect()}

    n = len(order)
    mean = [sum(errors[t][i] for t in range(40)) / 40 for i in range(n)]
    w = np.array([[sum((errors[t][i] - mean[i]) * (errors[t][j] - mean[j]) for t in range(40)) / 39 * (1 if i == j else 0.5) for j in range(n)] for i in range(n)])
    bottoms = [(s, f) for s in stores for f in families]
    s = np.array([[1.0] * 6, *[[float(b[0] == x) for b in bottoms] for x in stores], *[[float(b[1] == x) for b in bottoms] for x in families], *[[float(b == x) for b in bottoms] for x in bottoms]])
    want = np.linalg.solve(s.T @ np.linalg.solve(w, s), s.T @ np.linalg.solve(w, y.T)).T
    assert len(got) == 12
    for d, row in zip(days, want):
        for (store, family), v in zip(bottoms, row):
            assert got[d, int(store), family] == pytest.approx(v, abs=1e-9)
    with pytest.raises(ValueError):
        hierarchy.mint_shrink(base, residuals, max_series=5)


def test_covariance_counts_missing_rows_as_zero(spark):
    rows = [(DAY, "a", 1.0), (DAY, "a", 1.0), (DAY + timedelta(days=1), "b", 4.0), (DAY + timedelta(days=2), "other", 9.0)]
    got = hierarchy.residual_covariance(spark.createDataFrame(rows, "date date, series_id string, value double"), ["a", "b"])
    assert np.allclose(got, np.cov(np.array([[2, 0], [0, 4], [0, 0]]).T))


@pytest.mark.parametrize("method,weights", [("ols", None), ("wls_struct", "leaves")])
def test_grid_reconciliation_is_the_closed_form(spark, method, weights):
    rng, n_s, n_f = np.random.default_rng(3), 5, 7
    total, store, family, bottom = rng.uniform(50, 90), rng.uniform(5, 20, n_s), rng.uniform(5, 20, n_f), rng.uniform(0, 9, (n_s, n_f))
    rows = [(DAY, i, str(j), float(total), float(store[i]), float(family[j]), float(bottom[i, j])) for i in range(n_s) for j in range(n_f)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, base_total double, base_store double, base_family double, base_bottom double")
    got = {(r.store_nbr, int(r.family)): r.reconciled for r in hierarchy.reconcile_min_trace(df, method).collect()}
    s = np.array([[1.0] * 35, *[[float(c // n_f == i) for c in range(35)] for i in range(n_s)], *[[float(c % n_f == j) for c in range(35)] for j in range(n_f)], *np.eye(35)])
    w = np.eye(len(s)) if weights is None else np.diag(s.sum(axis=1))
    y = np.r_[total, store, family, bottom.ravel()]
    want = np.linalg.solve(s.T @ np.linalg.solve(w, s), s.T @ np.linalg.solve(w, y))
    assert all(got[c // n_f, c % n_f] == pytest.approx(want[c], abs=1e-10) for c in range(35))


def test_target_encoding_unmapped_values_and_empty_days(spark):
    rows = spark.createDataFrame([(DAY, 1, "LIQUOR,WINE,BEER", None, 9.0), (DAY, 1, "LIQUOR,WINE,BEER", None, 11.0), (DAY, 2, "X", None, -2.0), (DAY, 3, "Y", None, -2.0)],
                                 "date date, store_nbr int, family string, type string, sales double")
    got = features.add_target_encoding(rows, columns=["family"]).where("store_nbr = 1").first()
    assert got.family_target_enc == pytest.approx((2 * 10 + 10 * 4) / 12)
    plain = features.add_store_family_features(rows).where("store_nbr = 1").first()
    assert plain.family_group == "OTHER" and plain.store_type_num == 3
    days = spark.createDataFrame([(DAY, 1, "A", 0.0), (DAY + timedelta(days=1), 1, "A", 5.0)], "date date, store_nbr int, family string, sales double")
    assert hierarchy.top_down_proportions(days).first().proportion == pytest.approx(0.5)


def test_what_if_scales_forecast_and_interval(spark):
    rows = spark.createDataFrame([(DAY, 1, "no such family", 10.0, 5.0, 20.0)], "date date, store_nbr int, family string, pred double, pred_q05 double, pred_q95 double")
    got = business.what_if(rows, 0.5).first()
    assert (got.lift, got.pred_simulated, got.pred_q05_sim, got.pred_q95_sim) == pytest.approx((3.59, 35.9, 17.95, 71.8))
    assert business.what_if(rows, 0.5, {"no such family": 2.0}).first().lift == pytest.approx(1.5)


def test_shrunk_reconciliation_of_20_000_series(spark):
    """The normal equations S'W^-1 (y - S b) = 0 hold, W^-1 applied by its 30 dates; the largest matrix is that of the 301 upper series."""
    n_s, n_f, n_t, rng = 200, 100, 30, np.random.default_rng(5)
    names = np.array(["Total", *[f"Store_{i}" for i in range(n_s)], *[f"Family_f{j}" for j in range(n_f)], *[f"{i}_f{j}" for i in range(n_s) for j in range(n_f)]])
    n = len(names)
    scale = np.r_[50.0, np.full(n_s, 5.0), np.full(n_f, 8.0), rng.uniform(0.5, 2, n_s * n_f)]
    errors, y = rng.normal(size=(n_t, n)) * scale, rng.uniform(1, 9, n)
    days = np.array([DAY + timedelta(days=i) for i in range(n_t)])
    long = pd.DataFrame({"date": np.repeat(days, n), "series_id": np.tile(names, n_t), "value": errors.ravel()})
    base = pd.DataFrame({"date": days[-1], "level": [x.split("_")[0] if x.split("_")[0] in ("Total", "Store", "Family") else "Bottom" for x in names], "series_id": names, "value": y})
    got = hierarchy.mint_shrink(spark.createDataFrame(base), spark.createDataFrame(long)).toPandas()
    b = np.zeros((n_s, n_f))
    b[got["store_nbr"], got["family"].str[1:].astype(int)] = got["reconciled"]
    assert len(got) == n_s * n_f

    centred = errors - errors.mean(0)
    d = 0.5 * (centred ** 2).sum(0) / (n_t - 1)
    u = centred.T / np.sqrt(2 * (n_t - 1))
    rest = y - np.r_[b.sum(), b.sum(1), b.sum(0), b.ravel()]
    weighed = rest / d - (u / d[:, None]) @ np.linalg.solve(np.eye(n_t) + u.T @ (u / d[:, None]), u.T @ (rest / d))
    gradient = weighed[0] + weighed[1:1 + n_s][:, None] + weighed[1 + n_s:1 + n_s + n_f][None, :] + weighed[1 + n_s + n_f:].reshape(n_s, n_f)
    assert np.abs(gradient).max() < 1e-8 * np.abs(y / d).max()


def test_leafwise_runs(spark, folder):
    """Folds side by side, stored models, and metrics of the stored predictions."""
    columns = ["store_nbr", "family", "weekday"]
    folds = [models.Fold("a", None, date(2017, 7, 20), date(2017, 7, 21), date(2017, 7, 31)), models.Fold("b", None, date(2017, 7, 31), date(2017, 8, 1), date(2017, 8, 10))]
    few = boosting.Params(max_iter=8, min_rows=2, learning_rate=0.4)
    metrics = runs.train_leafwise(spark, f"{folder}/processed", f"{folder}/leafwise", f"{folder}/models", folds, columns, few).collect()
    oof = spark.read.parquet(f"{folder}/leafwise/oof_predictions.parquet").toPandas()
    assert {r.fold for r in metrics} == {"a", "b"} and len(oof) == 4 * 21
    for r in metrics:
        some = oof[oof["fold"] == r.fold]
        assert r.mae == pytest.approx((some["sales"] - some["pred"]).abs().mean()) and r.mae < 2
        assert r.rmsle == pytest.approx(np.sqrt(np.mean((np.log1p(some["pred"]) - np.log1p(some["sales"])) ** 2)))
    assert readers.load_error_by_family(spark, f"{folder}/leafwise").count() == 2
    stored = writers.load_boosted(spark, f"{folder}/models/leafwise_folds.json")
    assert set(stored) == {"a", "b"} and all(len(m.trees) <= 8 and m.losses for m in stored.values())


def test_quantile_model_run(spark, folder):
    columns = ["store_nbr", "family", "weekday"]
    few = boosting.quantile_params(max_iter=6, learning_rate=1.0, subsample=1.0)
    coverage = runs.predict_quantile_models(spark, f"{folder}/processed", f"{folder}/quantiles", f"{folder}/models", features=columns, params=few, point=boosting.Params(max_iter=10, min_rows=2, learning_rate=0.5)).first()
    got = readers.load_quantile_predictions(spark, f"{folder}/quantiles")
    assert got.columns == ["date", "store_nbr", "family", "unique_id", "sales", "pred", "pred_q05", "pred_q50", "pred_q95"] and got.count() == 15 * 4
    assert coverage.coverage_pct == pytest.approx(100 * got.where("sales between pred_q05 and pred_q95").count() / 60) and coverage.coverage_pct >= 90
    assert set(writers.load_boosted(spark, f"{folder}/models/quantile_models.json")) == {"pred", "pred_q05", "pred_q50", "pred_q95"}


def test_importance_and_metrics_are_those_of_the_models(spark):
    """Shares of the features add up to one for each model, a feature that says nothing has none, and metrics follow from the predictions."""
    rows = spark.range(1200).select((F.lit(DAY) + (F.col("id") / 12).cast("int")).alias("date"), (F.col("id") % 4).cast("int").alias("store_nbr"), F.concat(F.lit("F"), F.col("id") % 3).alias("family"),
                                    ((F.col("id") % 4) * 10 + F.col("id") % 5).cast("double").alias("sales"), F.lit(1.0).alias("flat"))
    last = DAY + timedelta(days=99)
    folds = [models.Fold("x", None, last - timedelta(days=20), last - timedelta(days=19), last - timedelta(days=10)), models.Fold("y", None, last - timedelta(days=10), last - timedelta(days=9), last)]
    metrics, fitted, oof = models.run_cv(rows, folds, features=["store_nbr", "flat"], params=TREES)
    table = {r.feature: r for r in models.feature_importance(spark, fitted).collect()}
    assert table["flat"].importance_mean == 0 and table["store_nbr"].importance_mean == pytest.approx(1) and sum(r.importance_pct for r in table.values()) == pytest.approx(100)
    some = oof.toPandas()
    assert len(some) == 240
    for r in metrics.collect():
        of_fold = some[some["fold"] == r.fold]
        assert r.mae == pytest.approx((of_fold["sales"] - of_fold["pred"]).abs().mean()) and r.mae < 3
    leafwise = models.run_cv_leafwise(rows, folds, features=["store_nbr", "flat"], params=boosting.Params(max_iter=3, min_rows=5), early_fraction=0.0)[1]
    table = {r.feature: r for r in models.leafwise_importance(spark, leafwise).collect()}
    assert table["flat"].importance_mean == 0 and table["store_nbr"].importance_mean == pytest.approx(1) and table["store_nbr"].importance_pct == pytest.approx(100)
