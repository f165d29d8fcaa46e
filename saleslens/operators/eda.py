"""Exploration: every function returns small lazy DataFrames; rounding is half-even, to the digits reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.calendar import weekday_label
from ..functions.text import unique_id
from .selection import exact_percentiles
from .temporal import event_distances, rolling_corr


def get_basic_stats(df: DataFrame) -> DataFrame:
    """One row: period, distinct counts, rows, zero share.  One pass."""
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("n_days"),
                  F.count_distinct("store_nbr").alias("n_stores"), F.count_distinct("family").alias("n_families"), F.count("*").alias("total_rows"),
                  stats.share(F.col("sales") == 0).alias("zero_sales_ratio"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row, nulls per column."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def analyze_zero_sales(df: DataFrame) -> DataFrame:
    x = F.col("sales")
    return df.groupBy("family").agg(F.bround(stats.share(x == 0), 4).alias("zero_ratio"),
                                    F.bround(F.coalesce(stats.mean_where(x, x > 0), F.lit(0.0)), 4).alias("mean_when_nonzero"), F.count(x).alias("count")).orderBy(F.desc("zero_ratio"))


def analyze_store_family_combinations(df: DataFrame, sparse_above: float = 0.9) -> DataFrame:
    out = df.groupBy("store_nbr", "family").agg(F.bround(stats.share(F.col("sales") == 0), 4).alias("zero_ratio"), F.bround(F.sum("sales"), 4).alias("total_sales"), F.count("sales").alias("n_days"))
    return out.withColumn("is_sparse", F.col("zero_ratio") > sparse_above)


def sales_distribution(df: DataFrame, column: str = "sales") -> DataFrame:
    """One row: mean, median, std, min, max, skewness and excess kurtosis (sample-corrected)."""
    x = F.col(column)
    rest = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                  stats.sample_skewness(x).alias("skewness"), stats.sample_kurtosis(x).alias("kurtosis"))
    median = F.broadcast(exact_percentiles(df, column, [0.5]).select(F.lit(1).alias("__one"), F.col("q")[0].alias("median")))  # a row each
    return rest.withColumn("__one", F.lit(1)).join(median, "__one", "left").select("mean", "median", "std", "min", "max", "skewness", "kurtosis")


def family_distribution(df: DataFrame, column: str = "sales") -> DataFrame:
    x = F.col(column)
    rest = df.groupBy("family").agg(*[f(x).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    medians = exact_percentiles(df, column, [0.5], ["family"]).select(F.col("family").alias("__f"), F.col("q")[0].alias("median"))
    out = rest.join(medians, F.col("family").eqNullSafe(F.col("__f")), "left")
    return out.select("family", *[F.bround(c, 2).alias(c) for c in ("mean", "median", "std", "min", "max")]).orderBy(F.desc("mean"))


def histogram(df: DataFrame, column: str = "sales", bins: int = 100, log: bool = False) -> DataFrame:
    """(bin, low, high, n) of the positive values in ``bins`` equal bins; empty ones are left out.  The ends are one collected row."""
    x = F.log1p(column) if log else F.col(column).cast("double")
    rows = df.where(F.col(column) > 0).select(x.alias("x"))
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    if ends.a is None or ends.a == ends.b:
        return rows.groupBy(F.lit(1).alias("bin"), F.col("x").alias("low"), F.col("x").alias("high")).agg(F.count("*").alias("n"))
    width = (ends.b - ends.a) / bins
    at = F.least(F.floor((F.col("x") - F.lit(ends.a)) / F.lit(width)).cast("int") + 1, F.lit(bins))
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(ends.a) + (F.col("bin") - 1) * F.lit(width)).alias("low"), (F.lit(ends.a) + F.col("bin") * F.lit(width)).alias("high"), "n")


def family_boxplot(df: DataFrame, top: int = 15) -> DataFrame:
    """Quartiles of the ``top`` families by mean."""
    best = df.groupBy("family").agg(F.avg("sales").alias("mean")).orderBy(F.desc("mean"), "family").limit(top)
    rows = df.join(F.broadcast(best.select(F.col("family").alias("__f"))), F.col("family").eqNullSafe(F.col("__f")), "left_semi")
    quartiles = exact_percentiles(rows, "sales", [0.25, 0.5, 0.75], ["family"]).select(F.col("family").alias("__f"), "q")
    out = best.join(quartiles, F.col("family").eqNullSafe(F.col("__f")), "left")
    return out.select("family", "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")).orderBy(F.desc("mean"), "family")


def day_of_week_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("dayofweek").agg(F.avg("sales").alias("mean_sales")).select("dayofweek", weekday_label(F.col("dayofweek")).alias("label"), "mean_sales")


def month_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.avg("sales").alias("mean_sales"))


def pivot_mean(df: DataFrame, rows: str, columns: str, values: list[int]) -> DataFrame:
    """Mean sales per ``rows``, a column per value of ``columns``; values are given, so no extra pass finds them."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg("sales"))


def year_month_pivot(df: DataFrame) -> DataFrame:
    return pivot_mean(df, "year", "month", list(range(1, 13)))


def dow_month_pivot(df: DataFrame) -> DataFrame:
    return pivot_mean(df, "dayofweek", "month", list(range(1, 13)))


def daily_totals(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy("date", *by).agg(F.sum("sales").alias("sales"))


def daily_moving_average(df: DataFrame, days: int = 7) -> DataFrame:
    """Daily totals and their moving average over ``days`` rows, null until the window is full."""
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(1 - days, 0)
    return daily_totals(df).withColumn("ma", F.when(F.count("sales").over(w) == days, F.avg("sales").over(w)))


def top_families(df: DataFrame, k: int = 10) -> DataFrame:
    return df.groupBy("family").agg(F.sum("sales").alias("total_sales")).orderBy(F.desc("total_sales"), "family").limit(k)


def top_family_series(df: DataFrame, k: int = 10) -> DataFrame:
    """Daily totals of the ``k`` best-selling families."""
    return daily_totals(df.join(F.broadcast(top_families(df, k).select("family")), "family", "left_semi"), "family")


def analyze_promotion_effect(df: DataFrame) -> DataFrame:
    """Mean sales without and with promotion per family, and the lift."""
    x, promoted = F.col("sales"), F.col("onpromotion") > 0
    out = df.groupBy("family").agg(stats.mean_where(x, ~promoted).alias("no_promo_sales"), stats.mean_where(x, promoted).alias("promo_sales"))
    return out.withColumn("promo_lift", F.try_divide("promo_sales", "no_promo_sales")).withColumn("promo_lift_pct", (F.col("promo_lift") - 1) * 100).orderBy(F.desc("promo_lift_pct"))


def _daily_with_price(df: DataFrame, *by: str) -> DataFrame:
    """A date has one price, so any of its rows gives it."""
    return df.groupBy("date", *by).agg(F.sum("sales").alias("sales"), F.max("dcoilwtico").alias("dcoilwtico")).dropna(subset=["sales", "dcoilwtico"])


def oil_correlation(df: DataFrame, rows: int = 30) -> DataFrame:
    """One row: correlation of daily totals and price, mean and deviation of the rolling correlation."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    daily = _daily_with_price(df).withColumn("__r", rolling_corr("sales", "dcoilwtico", rows, w))
    return daily.agg(stats.pearson("sales", "dcoilwtico").alias("overall_corr"), F.avg("__r").alias("rolling_corr_mean"), F.stddev_samp("__r").alias("rolling_corr_std"))


def rolling_oil_correlation(df: DataFrame, rows: int = 30) -> DataFrame:
    return _daily_with_price(df).select("date", rolling_corr("sales", "dcoilwtico", rows, Window.partitionBy(F.lit(1)).orderBy("date")).alias("rolling_corr"))


def oil_correlation_by_family(df: DataFrame) -> DataFrame:
    return _daily_with_price(df, "family").groupBy("family").agg(stats.pearson("sales", "dcoilwtico").alias("oil_correlation")).orderBy("oil_correlation")


def analyze_holiday_effect(df: DataFrame) -> DataFrame:
    """One row: mean sales on normal days and holidays, lift, and the same of national holidays.  Absent means are 0, the lift's divisor 1."""
    x, h, n = F.col("sales"), F.col("is_holiday"), F.col("is_national_holiday")
    out = df.agg(stats.mean_where(x, ~h).alias("__normal"), stats.mean_where(x, h).alias("__holiday"), stats.mean_where(x, ~n).alias("__other"), stats.mean_where(x, n).alias("__national"))
    zero = F.lit(0.0)
    return out.select(F.coalesce("__normal", zero).alias("normal_day_sales"), F.coalesce("__holiday", zero).alias("holiday_sales"),
                      F.try_divide(F.coalesce("__holiday", zero), F.coalesce("__normal", F.lit(1.0))).alias("holiday_lift"),
                      F.coalesce("__other", zero).alias("not_national_sales"), F.coalesce("__national", zero).alias("national_holiday_sales"))


def nearest_holiday_effect(df: DataFrame, within: int = 7, limit: int | None = None) -> DataFrame:
    """Mean sales by distance to the nearest holiday, up to ``within`` days; ``limit`` regards only the first so many holidays."""
    dates = df.groupBy("date").agg(F.bool_or("is_holiday").alias("h"))
    if limit is not None:
        nth = F.sum(F.col("h").cast("int")).over(Window.partitionBy(F.lit(1)).orderBy("date"))
        dates = dates.withColumn("h", F.col("h") & (nth <= limit))
    near = event_distances(dates, F.col("h"), cap=None).select("date", F.least("days_to_holiday", "days_since_holiday").alias("distance"))
    return df.join(F.broadcast(near), "date").where(F.col("distance") <= within).groupBy("distance").agg(F.avg("sales").alias("mean_sales"))


STORE_LEVELS = ("type", "cluster", "city", "state", "store_nbr")


def analyze_store_patterns(df: DataFrame) -> DataFrame:
    """(level, value, mean, sum, count) for every store attribute.

    Rows are first summed per store and its attributes, in one shuffle; the attributes' totals come from those few rows.
    """
    per_store = df.groupBy(*STORE_LEVELS).agg(F.sum("sales").alias("s"), F.count("sales").alias("n"))
    level = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in STORE_LEVELS]))
    out = per_store.select(level.alias("l"), "s", "n").groupBy("l.level", "l.value").agg(F.sum("s").alias("sum"), F.sum("n").alias("count"))
    return out.select("level", "value", (F.col("sum") / F.col("count")).alias("mean"), "sum", "count")


def last_rows(df: DataFrame, k: int, *by: str) -> DataFrame:
    """The last ``k`` rows in the order of ``by``, in that order; every task passes on ``k`` at most."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in by]).limit(k).orderBy(*[F.asc_nulls_first(c) for c in by])


def top_cities(df: DataFrame, k: int = 10) -> DataFrame:
    return df.groupBy("city").agg(F.sum("sales").alias("total_sales")).orderBy(F.desc("total_sales"), "city").limit(k)


def extreme_values(df: DataFrame, above: float = 10_000, column: str = "sales") -> DataFrame:
    return df.agg(F.count_if(F.col(column) > above).alias("n_extreme"), stats.share(F.col(column) > above).alias("share"))


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, deviation, min, quartiles and max of numeric columns, exact quartiles."""
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                     F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    rest = df.agg(F.array(*each).alias("r")).select(F.inline("r"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).select("x.c", "x.v")
    q = exact_percentiles(long, "v", [0.25, 0.5, 0.75], ["c"]).select("c", "q")
    quartiles = [F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return rest.join(q, F.col("column") == F.col("c"), "left").select("column", "count", "mean", "std", "min", *quartiles, "max")


def series_ids(df: DataFrame) -> DataFrame:
    return df.select(unique_id(F.col("store_nbr"), F.col("family")).alias("unique_id")).distinct()
