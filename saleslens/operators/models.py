"""Folds, baselines, error slices and gradient-boosted trees: leaf-wise ones of ``boosting``, and those of Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import boosting
from . import temporal as t
from .features import bool_to_int, get_categorical_columns, get_feature_columns


@dataclass(frozen=True)
class Fold:
    """Closed date ranges; ``train_start`` is the first date if open."""

    name: str
    train_start: date | None
    train_end: date
    val_start: date
    val_end: date

    def train(self, df: DataFrame, column: str = "date") -> DataFrame:
        rows = df.where(F.col(column) <= F.lit(self.train_end))
        return rows if self.train_start is None else rows.where(F.col(column) >= F.lit(self.train_start))

    def validation(self, df: DataFrame, column: str = "date") -> DataFrame:
        return df.where(F.col(column).between(F.lit(self.val_start), F.lit(self.val_end)))


class TimeSeriesFoldGenerator:
    """Folds counted in distinct dates from the end; fold 1 is the latest.  Training may slide over about three years."""

    def __init__(self, n_folds: int = 3, val_days: int = 16, gap_days: int = 0, expanding: bool = True, min_train_days: int = 365):
        self.n_folds, self.val_days, self.gap_days, self.expanding, self.min_train_days = n_folds, val_days, gap_days, expanding, min_train_days

    def split(self, df: DataFrame, column: str = "date") -> Iterator[Fold]:
        """The distinct dates (a few thousand) are collected; rows are selected by date ranges."""
        days = [r[0] for r in df.select(F.col(column).cast("date")).distinct().orderBy(column).collect()]
        for number in range(1, self.n_folds + 1):
            last = len(days) - 1 - (number - 1) * self.val_days
            first = last - self.val_days + 1
            end = first - 1 - self.gap_days
            if first < 0 or end < self.min_train_days:
                continue
            start = days[0] if self.expanding else days[max(0, end - 3 * 365)]
            yield Fold(f"Fold {number}", start, days[end], days[first], days[last])


def default_folds() -> list[Fold]:
    """Three half-month validation windows up to 2017-08-15."""
    d = date.fromisoformat
    windows = (("2017-07-01", "2017-07-15"), ("2017-07-16", "2017-07-31"), ("2017-08-01", "2017-08-15"))
    return [Fold(f"Fold {i}", None, d(a) - timedelta(days=1), d(a), d(b)) for i, (a, b) in enumerate(windows, 1)]


def fold_sizes(df: DataFrame, folds: list[Fold], column: str = "date") -> DataFrame:
    """(fold, train_size, val_size), all folds in one aggregate over the dates' counts."""
    per_day = df.groupBy(F.col(column).alias("d")).agg(F.count("*").alias("n"))
    parts = []
    for f in folds:
        train = F.col("d") <= F.lit(f.train_end) if f.train_start is None else F.col("d").between(F.lit(f.train_start), F.lit(f.train_end))
        parts.append(F.struct(F.lit(f.name).alias("fold"), F.coalesce(F.sum(F.when(train, F.col("n"))), F.lit(0)).alias("train_size"),
                              F.coalesce(F.sum(F.when(F.col("d").between(F.lit(f.val_start), F.lit(f.val_end)), F.col("n"))), F.lit(0)).alias("val_size")))
    return per_day.agg(F.array(*parts).alias("f")).select(F.inline("f"))


def get_cv_folds(df: DataFrame, folds: list[Fold] | None = None, column: str = "date") -> list[Fold]:
    """The folds that have validation rows."""
    folds = default_folds() if folds is None else folds
    some = {r.fold for r in fold_sizes(df, folds, column).where("val_size > 0").collect()}
    return [f for f in folds if f.name in some]


# Baselines

def add_naive_baselines(df: DataFrame, target: str = "sales", keys=t.KEYS, windows=(7, 28)) -> DataFrame:
    """``naive_last_week`` and ``naive_roll_{n}`` (mean of the n rows before), 0 where there is no history."""
    zero = F.lit(0.0)
    return df.withColumns({"naive_last_week": F.coalesce(F.lag(target, 7).over(t.series(keys)), zero)}
                          | {f"naive_roll_{n}": F.coalesce(t.rolling(F.col(target), "mean", n, keys), zero) for n in windows})


def compute_naive_baselines(df: DataFrame, in_validation: Column, target: str = "sales") -> DataFrame:
    """(method, metrics) on the validation rows; one window pass, one aggregate."""
    names = ["naive_last_week", "naive_roll_7", "naive_roll_28"]
    rows = add_naive_baselines(df, target).where(in_validation)
    long = rows.select(target, F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("pred")) for n in names])).alias("m")).select(target, "m.*")
    return long.groupBy("method").agg(*stats.all_metrics(F.col(target), F.col("pred")))


# Error slices

def analyze_errors_by_group(oof: DataFrame, group: str, actual: str = "sales", pred: str = "pred") -> DataFrame:
    a, p = F.col(actual), F.col(pred)
    return oof.groupBy(group).agg(*stats.all_metrics(a, p), F.count("*").alias("count"), F.avg(a).alias("mean_actual"), (stats.share(a == 0) * 100).alias("zero_pct")).orderBy("rmsle")


def analyze_promotion_errors(oof: DataFrame, panel: DataFrame, actual: str = "sales", pred: str = "pred") -> DataFrame:
    """Metrics by whether the row was promoted."""
    flags = panel.select("date", *t.KEYS, (F.col("onpromotion") > 0).cast("int").alias("has_promo")).dropDuplicates()
    rows = oof.drop("has_promo", "onpromotion").join(flags, ["date", *t.KEYS], "left").where(F.col("has_promo").isNotNull())
    return rows.groupBy("has_promo").agg(*stats.all_metrics(F.col(actual), F.col(pred)), F.count("*").alias("count"))


def analyze_zero_vs_nonzero(oof: DataFrame, actual: str = "sales", pred: str = "pred") -> DataFrame:
    """One row per actual zero or not: metrics, mean prediction, and percent predicted above 0 (the last two for zeros)."""
    a, p = F.col(actual), F.col(pred)
    return oof.groupBy((a == 0).alias("is_zero")).agg(*stats.all_metrics(a, p), F.count("*").alias("count"), F.avg(p).alias("mean_pred"), (stats.share(p > 0) * 100).alias("over_predict_pct"))


def summarize_cv(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.agg(F.avg("rmsle").alias("mean_rmsle"), F.stddev_samp("rmsle").alias("std_rmsle"), F.avg("mae").alias("mean_mae"), F.avg("mape").alias("mean_mape"), F.avg("bias").alias("mean_bias"))


# Gradient-boosted trees

def gbt_params(**changes) -> dict:
    """Spark ML has level-wise trees without leaf caps or L2, so these differ from leaf-wise boosting; raise maxIter for production."""
    return {"stepSize": 0.05, "maxIter": 40, "maxDepth": 6, "minInstancesPerNode": 50, "maxBins": 64, "subsamplingRate": 1.0, "seed": 42} | changes


def final_gbt_params(**changes) -> dict:
    """For the last fit on all rows: a third more trees than in cross-validation, and half the gain before boosting stops."""
    return gbt_params(maxIter=54, validationTol=0.005) | changes


def model_frame(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Features as numbers, nulls 0, booleans 0 or 1."""
    rows = bool_to_int(df.select(*dict.fromkeys([*keep, *features])))
    return rows.fillna(0, subset=[c for c, k in rows.dtypes if c in features and k != "string"])


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer), the same in every run: those with the smallest hashes of the whole row.

    Every partition passes its ``n`` smallest on, so ``n`` bounds what one task gets.  Repeated rows stand next to each other.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])).limit(n)


def fit_labels(rows: DataFrame, categorical: list[str]) -> PipelineModel:
    """``{c}__text`` to ``{c}__code`` per column: the place of the string in alphabetical order; unseen and null ones -1.

    Codes are plain numbers to the trees, so their count isn't limited by the bins of a categorical feature.
    """
    index = StringIndexer(inputCols=[f"{c}__text" for c in categorical], outputCols=[f"{c}__index" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep")
    indexer = index.fit(rows)
    codes = [f"CASE WHEN `{c}__index` = {len(labels)} THEN -1D ELSE `{c}__index` END AS `{c}__code`" for c, labels in zip(categorical, indexer.labelsArray, strict=True)]
    return PipelineModel([indexer, SQLTransformer(statement=f"SELECT *, {', '.join(codes)} FROM __THIS__")])


def _texts(df: DataFrame, categorical: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__text": F.col(c).cast("string") for c in categorical}) if categorical else df


def train_gbt(train: DataFrame, target: str = "sales", features: list[str] | None = None, categorical: list[str] | None = None, params: dict | None = None,
              validation: DataFrame | None = None, weight_log: bool = False, early_fraction: float = 0.0) -> PipelineModel:
    """Pipeline of label codes (``categorical`` columns and all strings among ``features``), assembly and trees.

    Boosting stops early once the error of held-out rows falls no more: those of ``validation``, or else the share ``early_fraction`` of the
    training rows, chosen by a hash of the row so that every run holds out the same (equal rows stay together).
    """
    features = get_feature_columns(train) if features is None else features
    kinds = dict(train.dtypes)
    categorical = get_categorical_columns(train) if categorical is None else categorical
    categorical = [c for c in features if c in categorical or kinds[c] == "string"]
    label = F.log1p(target) if weight_log else F.col(target).cast("double")
    params = gbt_params() if params is None else params

    def framed(df: DataFrame) -> DataFrame:
        return _texts(model_frame(df, features, [target]), categorical).withColumn("__label", label)

    rows = framed(train)
    if validation is not None:
        rows = rows.withColumn("__validation", F.lit(False)).unionByName(framed(validation).withColumn("__validation", F.lit(True)))
    elif early_fraction:
        held = F.pmod(F.xxhash64(F.lit(params.get("seed", 42)), *dict.fromkeys([target, *features])), F.lit(10_000)) < round(early_fraction * 10_000)
        rows = rows.withColumn("__validation", held)
    gbt = GBTRegressor(featuresCol="__features", labelCol="__label", predictionCol="__raw", **params)
    if "__validation" in rows.columns:
        gbt = gbt.setValidationIndicatorCol("__validation")
    stages = [fit_labels(rows.where("not __validation") if "__validation" in rows.columns else rows, categorical)] if categorical else []
    stages.append(VectorAssembler(inputCols=[f for f in features if f not in categorical] + [f"{c}__code" for c in categorical], outputCol="__features"))
    return Pipeline(stages=[*stages, gbt]).fit(rows)


def predict_gbt(model: PipelineModel, df: DataFrame, clip_negative: bool = True, from_log: bool = False, out: str = "pred") -> DataFrame:
    """``df`` with the prediction; features and prediction stay in one row."""
    inputs = model.stages[-2].getInputCols()
    codes = [c.removesuffix("__code") for c in inputs if c.endswith("__code")]
    numbers = [c for c in inputs if not c.endswith("__code")]
    kinds = dict(df.dtypes)
    rows = _texts(df, codes).withColumns({f"__keep_{i}": F.col(c) for i, c in enumerate(numbers)})
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("int" if kinds[c] == "boolean" else kinds[c]), F.lit(0)) for c in numbers})
    raw = F.expm1("__raw") if from_log else F.col("__raw")
    got = model.transform(rows).withColumn(out, F.greatest(raw, F.lit(0.0)) if clip_negative else raw)
    return got.select(*[F.col(f"__keep_{numbers.index(c)}").alias(c) if c in numbers else F.col(c) for c in df.columns if c != out], out)


def run_cv(df: DataFrame, folds: list[Fold] | None = None, target: str = "sales", features: list[str] | None = None, params: dict | None = None,
           log_target: bool = False, early_fraction: float = 0.1) -> tuple[DataFrame, list[PipelineModel], DataFrame]:
    """(metrics per fold, models, out-of-fold predictions); each fold's trees stop early on the share ``early_fraction`` of its training rows."""
    models, parts = [], []
    for f in get_cv_folds(df, folds):
        model = train_gbt(f.train(df), target, features, params=params, weight_log=log_target, early_fraction=early_fraction)
        models.append(model)
        parts.append(predict_gbt(model, f.validation(df), from_log=log_target).select("date", *t.KEYS, target, "pred", F.lit(f.name).alias("fold")))
    if not parts:
        raise ValueError("no fold has validation rows")
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return oof.groupBy("fold").agg(*stats.all_metrics(F.col(target), F.col("pred"))), models, oof


def feature_importance(spark, models: list[PipelineModel]) -> DataFrame:
    """(feature, importance_mean, importance_std, importance_pct) over the models."""
    rows = []
    for i, m in enumerate(models):
        names = [c.removesuffix("__code") for c in m.stages[-2].getInputCols()]
        rows += [(i, n, float(v)) for n, v in zip(names, m.stages[-1].featureImportances.toArray(), strict=True)]
    return importance_table(spark.createDataFrame(rows, "fold int, feature string, importance double"))


def importance_table(each: DataFrame) -> DataFrame:
    """Mean, deviation and percentage per feature of the rows (feature, importance) of several models."""
    mean = each.groupBy("feature").agg(F.avg("importance").alias("importance_mean"), F.stddev_samp("importance").alias("importance_std"))
    total = mean.agg(F.sum("importance_mean")).first()[0] or 0.0
    return mean.withColumn("importance_pct", F.col("importance_mean") / F.lit(total + 1e-10) * 100).orderBy(F.desc("importance_mean"))


# Leaf-wise trees

def leafwise_params(**changes) -> boosting.Params:
    """Steps of 0.05, up to 1,500 trees of at most 63 leaves and depth 10, 50 rows a leaf, L2 of 1, patience of 50 trees."""
    return boosting.Params(**changes)


def final_leafwise_params(**changes) -> boosting.Params:
    """For the last fit on all rows: up to 2,000 trees and a patience of 100."""
    return boosting.Params(**({"max_iter": 2000, "patience": 100} | changes))


@dataclass
class Leafwise:
    """Models by name, all of the same features, and the label codes of the strings among them."""

    features: list[str]
    categorical: list[str]
    models: dict[str, boosting.Model]
    labels: PipelineModel | None = None


def _held_share(df: DataFrame, target: str, features: list[str], fraction: float, seed: int) -> Column | None:
    """The rows whose hash of target and features falls into the first ``fraction``; equal rows stay together."""
    return F.pmod(F.xxhash64(F.lit(seed), *dict.fromkeys([target, *features])), F.lit(10_000)) < round(fraction * 10_000) if fraction else None


def fit_leafwise(df: DataFrame, tasks: Sequence[boosting.Task], target: str = "sales", features: list[str] | None = None, categorical: list[str] | None = None,
                 params: boosting.Params | None = None) -> Leafwise:
    """All tasks' models in the same passes over one table of bins; label codes are those of all tasks' training rows."""
    features = get_feature_columns(df) if features is None else features
    kinds = dict(df.dtypes)
    categorical = get_categorical_columns(df) if categorical is None else categorical
    categorical = [c for c in features if c in categorical or kinds[c] == "string"]
    flags = {f"__train_{i}": F.coalesce(x.train, F.lit(False)) for i, x in enumerate(tasks)}
    flags |= {f"__held_{i}": F.coalesce(x.held, F.lit(False)) for i, x in enumerate(tasks) if x.held is not None}
    flagged = df.withColumns(flags)
    used = F.greatest(F.lit(0), *[F.col(f"__train_{i}").cast("int") for i in range(len(tasks))]) > 0
    rows = _texts(model_frame(flagged.where(used), features, [target, *flags]), categorical)
    labels = fit_labels(rows, categorical) if categorical else None
    numbers = [f"{c}__code" if c in categorical else c for c in features]
    ours = [boosting.Task(x.name, F.col(f"__train_{i}") > 0, F.col(f"__held_{i}") > 0 if x.held is not None else None, x.quantile) for i, x in enumerate(tasks)]
    return Leafwise(features, categorical, boosting.fit(labels.transform(rows) if labels else rows, target, numbers, ours, params), labels)


def predict_leafwise(fitted: Leafwise, df: DataFrame, clip_negative: bool = True, names: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the predictions of all models, or of those in ``names`` (model: column)."""
    names = {n: n for n in fitted.models} if names is None else names
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names.values()]
    rows = df.select(F.struct(*keep).alias("__row"), *[F.col(f"`{c}`") for c in fitted.features])
    rows = _texts(model_frame(rows, fitted.features, ["__row"]), fitted.categorical)
    rows = fitted.labels.transform(rows) if fitted.labels else rows
    got = boosting.predict(rows, {column: fitted.models[n] for n, column in names.items()}, clip_negative)
    return got.select("__row.*", *names.values())


def run_cv_leafwise(df: DataFrame, folds: list[Fold] | None = None, target: str = "sales", features: list[str] | None = None, params: boosting.Params | None = None,
                    early_fraction: float = 0.1) -> tuple[DataFrame, Leafwise, DataFrame]:
    """(metrics per fold, models by fold, out-of-fold predictions).

    The folds share one table of bins and are trained side by side; each stops on the share ``early_fraction`` of its own training rows.
    """
    folds = get_cv_folds(df, folds)
    if not folds:
        raise ValueError("no fold has validation rows")
    features = get_feature_columns(df) if features is None else features
    seed = (params or boosting.Params()).seed
    held = _held_share(df, target, features, early_fraction, seed)
    tasks = []
    for f in folds:
        train = F.col("date") <= F.lit(f.train_end)
        tasks.append(boosting.Task(f.name, train if f.train_start is None else train & (F.col("date") >= F.lit(f.train_start)), held))
    fitted = fit_leafwise(df, tasks, target, features, params=params)
    oof = None
    for f in folds:
        part = predict_leafwise(fitted, f.validation(df), names={f.name: "pred"}).select("date", *t.KEYS, target, "pred", F.lit(f.name).alias("fold"))
        oof = part if oof is None else oof.unionByName(part)
    return oof.groupBy("fold").agg(*stats.all_metrics(F.col(target), F.col("pred"))), fitted, oof


def leafwise_importance(spark, fitted: Leafwise) -> DataFrame:
    """(feature, importance_mean, importance_std, importance_pct) over the models, by the gains of their splits."""
    rows = [(name, f.removesuffix("__code"), share) for name, m in fitted.models.items() for f, share in m.importance().items()]
    return importance_table(spark.createDataFrame(rows, "fold string, feature string, importance double"))


def train_quantile_models(df: DataFrame, train: Column, quantiles=(0.05, 0.5, 0.95), target: str = "sales", features: list[str] | None = None,
                          params: boosting.Params | None = None) -> Leafwise:
    """A model with the pinball loss per quantile, named like its column (``pred_q05``), trained side by side on the rows where ``train`` holds."""
    tasks = [boosting.Task(quantile_name(q), train, quantile=q) for q in quantiles]
    return fit_leafwise(df, tasks, target, features, params=boosting.quantile_params() if params is None else params)


# Intervals

def quantile_name(q: float) -> str:
    return f"pred_q{round(q * 100):02d}"


def fit_residual_quantiles(calibration: DataFrame, quantiles=(0.05, 0.5, 0.95), actual: str = "sales", pred: str = "pred", by: str = "family", accuracy: int = 10_000) -> DataFrame:
    """Split-conformal intervals: quantiles of the residuals of held-out rows per ``by``.  (Boosting with a quantile loss isn't in Spark ML.)

    Ranks are right to 1 / ``accuracy`` of the rows, in a sketch of bounded size however many residuals differ.
    """
    q = F.percentile_approx(F.col(actual) - F.col(pred), list(quantiles), accuracy)
    return calibration.groupBy(by).agg(q.alias("q")).select(by, *[F.col("q")[i].alias(f"__{quantile_name(x)}") for i, x in enumerate(quantiles)])


def predict_quantiles(df: DataFrame, residuals: DataFrame, quantiles=(0.05, 0.5, 0.95), pred: str = "pred", by: str = "family") -> DataFrame:
    """``df`` with a column per quantile, at least 0."""
    out = df.join(residuals, by, "left")
    names = [quantile_name(q) for q in quantiles]
    return out.withColumns({n: F.greatest(F.col(pred) + F.coalesce(f"__{n}", F.lit(0.0)), F.lit(0.0)) for n in names}).drop(*[f"__{n}" for n in names])
