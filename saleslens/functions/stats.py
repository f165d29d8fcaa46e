"""Statistics and accuracy measures as aggregate expressions, so several of them share one pass and one shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values or no spread."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def mean_where(x: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, x))


def log_error(actual: Column, predicted: Column, clip: str = "pred") -> Column:
    """log1p difference; ``clip``: negative values count as 0 in ``pred``, in ``both`` or in ``none`` (NaN below -1)."""
    if clip not in ("pred", "both", "none"):
        raise ValueError(f"clip: pred, both or none, not {clip}")
    p = predicted if clip == "none" else F.greatest(predicted, F.lit(0.0))
    a = F.greatest(actual, F.lit(0.0)) if clip == "both" else actual
    return F.log1p(p) - F.log1p(a)


def rmsle(actual: Column, predicted: Column, clip: str = "pred") -> Column:
    return F.sqrt(F.avg(F.pow(log_error(actual, predicted, clip), 2)))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mape(actual: Column, predicted: Column, epsilon: float = 1.0) -> Column:
    """Percent, of actual + epsilon."""
    return F.avg(F.abs((actual - predicted) / (actual + epsilon))) * 100


def bias(actual: Column, predicted: Column) -> Column:
    return F.avg(predicted - actual)


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(predicted - actual, 2)))


def all_metrics(actual: Column, predicted: Column, clip: str = "pred") -> list[Column]:
    return [rmsle(actual, predicted, clip).alias("rmsle"), mae(actual, predicted).alias("mae"), mape(actual, predicted).alias("mape"),
            bias(actual, predicted).alias("bias"), rmse(actual, predicted).alias("rmse")]


def dashboard_metrics(actual: Column, predicted: Column) -> list[Column]:
    """As shown on the dashboard: nothing is clipped."""
    return [rmsle(actual, predicted, "none").alias("rmsle"), mae(actual, predicted).alias("mae"), mape(actual, predicted).alias("mape")]


def coverage(actual: Column, low: Column, high: Column) -> Column:
    """Percent of actual values inside [low, high]."""
    return share(actual.between(low, high)) * 100


def pearson(a: str, b: str) -> Column:
    """Correlation aggregate; null if a column doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
