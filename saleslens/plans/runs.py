"""Runs from files to files: master panel, features, exploration, models, reconciliation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import unique_id
from ..operators import boosting, eda, hierarchy, models
from ..operators.features import create_all_features, prepare_train_val_split
from ..operators.panel import assemble
from ..operators.stl import perform_stl_decomposition
from ..sources import readers, writers


def create_master_dataframe(spark: SparkSession, data_dir: str, processed_dir: str | None = None) -> DataFrame:
    """Raw CSV files to the master panel, written if ``processed_dir`` is given."""
    master = assemble(readers.load_train_data(spark, data_dir), readers.load_stores_data(spark, data_dir), readers.load_oil_data(spark, data_dir), readers.load_holidays_data(spark, data_dir))
    if processed_dir is None:
        return master
    path = f"{processed_dir}/train_merged.parquet"
    writers.write_parquet(master, path, sort_by=("date", "store_nbr", "family"))
    return spark.read.parquet(path)


def create_features(spark: SparkSession, processed_dir: str, val_start: str = "2017-08-01", val_end: str = "2017-08-15", table: str | None = None) -> DataFrame:
    """Master panel to features, their list, and training and validation tables; with ``table`` also a table bucketed by series."""
    path = f"{processed_dir}/train_features.parquet"
    writers.write_parquet(create_all_features(readers.load_master_dataframe(spark, processed_dir), encode_before=val_start), path, sort_by=("store_nbr", "family", "date"), floats=True)
    features = spark.read.parquet(path)
    train, val = prepare_train_val_split(features, val_start, val_end)
    writers.write_parquet(train, f"{processed_dir}/train_features_train.parquet")
    writers.write_parquet(val, f"{processed_dir}/train_features_val.parquet")
    writers.save_feature_list(features, f"{processed_dir}/features_list")
    if table:
        writers.write_series_table(features, table)
    return features


def run_full_eda(df: DataFrame) -> dict[str, DataFrame]:
    """All analyses, lazy; cache ``df`` to share its scan."""
    return {
        "basic_stats": eda.get_basic_stats(df), "missing_values": eda.null_counts(df), "zero_sales": eda.analyze_zero_sales(df), "store_family_sparsity": eda.analyze_store_family_combinations(df),
        "sales_overall": eda.sales_distribution(df), "sales_by_family": eda.family_distribution(df), "histogram": eda.histogram(df), "log_histogram": eda.histogram(df, log=True), "boxplot": eda.family_boxplot(df),
        "day_of_week": eda.day_of_week_profile(df), "month": eda.month_profile(df), "year_month": eda.year_month_pivot(df), "dow_month": eda.dow_month_pivot(df), "daily": eda.daily_moving_average(df),
        "promotion": eda.analyze_promotion_effect(df), "oil": eda.oil_correlation(df), "oil_by_family": eda.oil_correlation_by_family(df), "holiday": eda.analyze_holiday_effect(df), "holiday_distance": eda.nearest_holiday_effect(df),
        "store_patterns": eda.analyze_store_patterns(df), "stl": perform_stl_decomposition(df), "top_families": eda.top_families(df), "top_family_series": eda.top_family_series(df),
    }


def generate_eda_report(results: dict[str, DataFrame]) -> str:
    """Markdown from the one-row and few-row results of ``run_full_eda``."""
    def one(name: str):
        return results[name].first()

    def num(x, form: str) -> str:
        return "n/a" if x is None else format(x, form)

    s, d, o, h = one("basic_stats"), one("sales_overall"), one("oil"), one("holiday")
    dow = results["day_of_week"].agg(F.max_by("label", "mean_sales").alias("peak"), F.min_by("label", "mean_sales").alias("low")).first()
    lift = results["promotion"].agg(F.avg("promo_lift_pct")).first()[0]
    sparse = results["store_family_sparsity"].agg(stats.share(F.col("is_sparse")) * 100).first()[0]
    lines = [
        "# Sales panel report", "", "| Measure | Value |", "|---|---|", f"| Period | {s.first_date} to {s.last_date} |", f"| Days | {s.n_days:,} |", f"| Stores | {s.n_stores} |", f"| Families | {s.n_families} |",
        f"| Rows | {s.total_rows:,} |", f"| Zero share | {num(s.zero_sales_ratio and s.zero_sales_ratio * 100, '.1f')} % |", "",
        "## Distribution", "", f"Mean {num(d['mean'], '.2f')}, median {num(d['median'], '.2f')}, deviation {num(d['std'], '.2f')}, skewness {num(d['skewness'], '.2f')}.", "",
        "## Seasons", "", f"Best weekday {dow.peak}, weakest {dow.low}.", "", "## Promotion", "", f"Mean lift over families {num(lift, '.1f')} %.", "",
        "## Oil price", "", f"Correlation with daily totals {num(o.overall_corr, '.3f')}.", "", "## Holidays", "", f"Lift {num(h.holiday_lift, '.2f')} x.", "",
        "## Intermittent series", "", f"{num(sparse, '.1f')} % of the series have over 90 % zeros.", ""]
    return "\n".join(lines)


def train_and_evaluate(spark: SparkSession, processed_dir: str, predictions_dir: str, models_dir: str, folds: list | None = None, params: dict | None = None) -> DataFrame:
    """Cross-validation, error slices and stored models; returns the metrics per fold."""
    df = readers.load_parquet(spark, f"{processed_dir}/train_features.parquet")
    metrics, fitted, oof = models.run_cv(df, folds, params=params)
    writers.write_parquet(oof, f"{predictions_dir}/oof_predictions.parquet")
    oof = spark.read.parquet(f"{predictions_dir}/oof_predictions.parquet")
    writers.write_csv(models.analyze_errors_by_group(oof, "family"), f"{predictions_dir}/error_by_family.csv")
    writers.save_models(fitted, models_dir)
    return oof.groupBy("fold").agg(*stats.all_metrics(F.col("sales"), F.col("pred")))


def train_final_model(spark: SparkSession, processed_dir: str, models_dir: str, until: str = "2017-08-15", features: list[str] | None = None, params: dict | None = None) -> PipelineModel:
    """The model to use: fitted on every row up to ``until``, boosting stopped early on a tenth of them; stored as ``model_final``."""
    rows = readers.load_parquet(spark, f"{processed_dir}/train_features.parquet").where(F.col("date") <= F.lit(until).cast("date"))
    model = models.train_gbt(rows, features=features, params=models.final_gbt_params() if params is None else params, early_fraction=0.1)
    writers.save_model(model, f"{models_dir}/model_final")
    return model


def predict_intervals(spark: SparkSession, processed_dir: str, predictions_dir: str, models_dir: str, val_start: str = "2017-08-01", val_end: str = "2017-08-15", calibration_days: int = 16,
                      features: list[str] | None = None, params: dict | None = None, quantiles=(0.05, 0.5, 0.95)) -> DataFrame:
    """Forecasts of the validation days with their quantiles, written as ``quantile_predictions.parquet``; returns the coverage in percent.

    The model sees the days before the last ``calibration_days`` ahead of ``val_start``; residuals of those give the quantiles per family,
    stored beside the model.  A family without calibration rows gets the forecast itself as its quantiles.
    """
    first, last = date.fromisoformat(val_start), date.fromisoformat(val_end)
    cut = first - timedelta(days=calibration_days)
    df = readers.load_parquet(spark, f"{processed_dir}/train_features.parquet")
    model = models.train_gbt(df.where(F.col("date") < F.lit(cut)), features=features, params=params, early_fraction=0.1)
    held = models.predict_gbt(model, df.where((F.col("date") >= F.lit(cut)) & (F.col("date") < F.lit(first))))
    writers.write_parquet(models.fit_residual_quantiles(held, quantiles), f"{models_dir}/residual_quantiles.parquet")
    writers.save_model(model, f"{models_dir}/model_intervals")
    residuals = spark.read.parquet(f"{models_dir}/residual_quantiles.parquet")
    val = models.predict_gbt(model, df.where(F.col("date").between(F.lit(first), F.lit(last))))
    out = models.predict_quantiles(val, residuals, quantiles).withColumn("unique_id", unique_id(F.col("store_nbr"), F.col("family")))
    path = f"{predictions_dir}/quantile_predictions.parquet"
    writers.write_parquet(out.select("date", "store_nbr", "family", "unique_id", "sales", "pred", *map(models.quantile_name, quantiles)), path)
    low, high = models.quantile_name(min(quantiles)), models.quantile_name(max(quantiles))
    return spark.read.parquet(path).agg((stats.share(F.col("sales").between(F.col(low), F.col(high))) * 100).alias("coverage_pct"))


def train_leafwise(spark: SparkSession, processed_dir: str, predictions_dir: str, models_dir: str, folds: list | None = None, features: list[str] | None = None,
                   params: boosting.Params | None = None) -> DataFrame:
    """As ``train_and_evaluate`` with leaf-wise trees: all folds are trained side by side on one table of bins; returns the metrics per fold."""
    df = readers.load_parquet(spark, f"{processed_dir}/train_features.parquet")
    _, fitted, oof = models.run_cv_leafwise(df, folds, features=features, params=params)
    writers.write_parquet(oof, f"{predictions_dir}/oof_predictions.parquet")
    oof = spark.read.parquet(f"{predictions_dir}/oof_predictions.parquet")
    writers.write_csv(models.analyze_errors_by_group(oof, "family"), f"{predictions_dir}/error_by_family.csv")
    writers.save_boosted(spark, fitted.models, f"{models_dir}/leafwise_folds.json")
    return oof.groupBy("fold").agg(*stats.all_metrics(F.col("sales"), F.col("pred")))


def predict_quantile_models(spark: SparkSession, processed_dir: str, predictions_dir: str, models_dir: str, val_start: str = "2017-08-01", val_end: str = "2017-08-15", features: list[str] | None = None,
                            params: boosting.Params | None = None, point: boosting.Params | None = None, quantiles=(0.05, 0.5, 0.95)) -> DataFrame:
    """As ``predict_intervals`` with a model of pinball loss per quantile, trained on all rows before ``val_start``; returns the coverage in percent."""
    first, last = date.fromisoformat(val_start), date.fromisoformat(val_end)
    df = readers.load_parquet(spark, f"{processed_dir}/train_features.parquet")
    before = F.col("date") < F.lit(first)
    fitted = models.train_quantile_models(df, before, quantiles, features=features, params=params)
    mean = models.fit_leafwise(df, [boosting.Task("pred", before)], features=features, params=point)
    writers.save_boosted(spark, fitted.models | mean.models, f"{models_dir}/quantile_models.json")
    val = models.predict_leafwise(mean, df.where(F.col("date").between(F.lit(first), F.lit(last))))
    out = models.predict_leafwise(fitted, val).withColumn("unique_id", unique_id(F.col("store_nbr"), F.col("family")))
    path = f"{predictions_dir}/quantile_predictions.parquet"
    names = list(map(models.quantile_name, quantiles))
    writers.write_parquet(out.select("date", "store_nbr", "family", "unique_id", "sales", "pred", *names), path)
    low, high = models.quantile_name(min(quantiles)), models.quantile_name(max(quantiles))
    return spark.read.parquet(path).agg((stats.share(F.col("sales").between(F.col(low), F.col(high))) * 100).alias("coverage_pct"))


def reconcile_and_evaluate(spark: SparkSession, forecasts: DataFrame, predictions_dir: str) -> DataFrame:
    """Bottom forecasts (date, store_nbr, family, sales, pred) to reconciled forecasts and their evaluation by level."""
    path = f"{predictions_dir}/reconciled_forecasts.parquet"
    writers.write_parquet(hierarchy.reconcile_forecasts(forecasts), path)
    reconciled = spark.read.parquet(path)
    evaluation = hierarchy.evaluate_at_levels(reconciled)
    writers.write_csv(evaluation, f"{predictions_dir}/hierarchical_evaluation.csv")
    return evaluation
