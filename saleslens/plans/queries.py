"""Registered queries, each beside the SQL that gives the same rows.  Doubles are rounded in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import boosting, business, eda, features, hierarchy, models, panel, temporal
from ..operators.stl import perform_stl_decomposition
from ..sources.staging import stage
from . import driver_panel as dp
from .sql_base import with_base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ("date", "store_nbr", "family")
W = "WINDOW w AS (PARTITION BY store_nbr, family ORDER BY date)"


def query(sql: str | None = None, *base: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_base(sql, *base) if base else sql
        return f
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {c: F.round(c, digits) for c, k in df.dtypes if k in ("double", "float")}
    return df.withColumns(doubles) if doubles else df


def r(names, digits: int = 6, f: str = "{}") -> str:
    """SQL list ``round(x, digits) AS x``."""
    return ", ".join(f"round({f.format(n)}, {digits}) AS {n}" for n in names)


# Panel and dimensions

MASTER = ("date", "store_nbr", "family", "sales", "onpromotion", "city", "state", "type", "cluster", "dcoilwtico", "holiday_type", "is_national_holiday", "is_regional_holiday", "is_local_holiday", "is_transferred",
          "holiday_description", "is_holiday", "year", "month", "day", "dayofweek", "dayofyear", "weekofyear", "is_weekend", "is_month_start", "is_month_end")


@query(f"SELECT {', '.join(MASTER)} FROM master", "master")
def panel_master(spark, sf):
    return dp.master(spark, sf).select(*MASTER)


@query("SELECT date, store_nbr, family, sales, onpromotion FROM panel", "panel")
def panel_dense(spark, sf):
    return dp.panel(spark, sf).select(*KEY, "sales", "onpromotion")


@query("SELECT * FROM hol", "hol")
def holiday_agg(spark, sf):
    return panel.process_holidays(dp.holidays(spark), "ord")


@query("SELECT date, CAST(coalesce(least(to_raw, 30), 30) AS INT) AS days_to_holiday, CAST(coalesce(least(since_raw, 30), 30) AS INT) AS days_since_holiday FROM distances", "distances")
def holiday_distance(spark, sf):
    return features.add_holiday_features(dp.master(spark, sf)).select("date", "days_to_holiday", "days_since_holiday").distinct()


_FLAGS = ("is_pre_holiday_1", "is_pre_holiday_2", "is_pre_holiday_3", "is_post_holiday_1", "is_post_holiday_2", "is_bridge_holiday", "is_transfer_holiday", "is_workday_holiday")


@query("""SELECT m.date, store_nbr, family, CAST(coalesce(to_raw = 1, false) AS INT) AS is_pre_holiday_1, CAST(coalesce(to_raw = 2, false) AS INT) AS is_pre_holiday_2, CAST(coalesce(to_raw <= 3, false) AS INT) AS is_pre_holiday_3,
  CAST(coalesce(since_raw = 1, false) AS INT) AS is_post_holiday_1, CAST(coalesce(since_raw = 2, false) AS INT) AS is_post_holiday_2, CAST(holiday_type ILIKE '%bridge%' AS INT) AS is_bridge_holiday,
  CAST(holiday_type ILIKE '%transfer%' AS INT) AS is_transfer_holiday, CAST(holiday_type ILIKE '%work%' AS INT) AS is_workday_holiday FROM master m JOIN distances d ON d.date = m.date""", "distances")
def holiday_flags(spark, sf):
    return features.add_holiday_features(dp.master(spark, sf)).select(*KEY, *_FLAGS)


@query("""SELECT least(to_raw, since_raw) AS distance, round(avg(sales), 6) AS mean_sales FROM master m JOIN distances d ON d.date = m.date
  WHERE least(to_raw, since_raw) <= 7 GROUP BY 1""", "distances")
def nearest_holiday_effect(spark, sf):
    return rounded(eda.nearest_holiday_effect(dp.master(spark, sf))).withColumn("distance", F.col("distance").cast("long"))


@query("""SELECT p.date, o.dcoilwtico AS price FROM (SELECT DISTINCT date FROM panel) p ASOF LEFT JOIN oil o ON o.date <= p.date""", "panel", "oil")
def asof_price(spark, sf):
    return panel.prices_as_of(dp.facts(spark, sf), dp.prices(spark, sf)).select("date", F.col("dcoilwtico").alias("price"))


@query("SELECT date, dcoilwtico FROM filled", "filled")
def ffill_oil(spark, sf):
    return panel.filled_prices(dp.facts(spark, sf), dp.prices(spark, sf)).select("date", "dcoilwtico")


# Calendar

_DATES = "(SELECT DISTINCT date AS d FROM fact)"


@query(f"""SELECT d AS date, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, CAST(isodow(d) - 1 AS INT) AS dayofweek, CAST(dayofyear(d) AS INT) AS dayofyear,
  CAST(weekofyear(d) AS INT) AS weekofyear, CAST(quarter(d) AS INT) AS quarter, isodow(d) >= 6 AS is_weekend, day(d) = 1 AS is_month_start, d = last_day(d) AS is_month_end, CAST(day(last_day(d)) AS INT) AS days_in_month,
  round(sin(2 * pi() * day(d) / day(last_day(d))), 6) AS day_of_month_sin, round(cos(2 * pi() * day(d) / day(last_day(d))), 6) AS day_of_month_cos, day(d) = 15 OR d = last_day(d) AS is_payday,
  CAST(least(abs(day(d) - 15), day(last_day(d)) - day(d), day(d)) AS INT) AS days_to_payday, CAST(day(d) - 1 AS INT) AS days_since_month_start, CAST(day(last_day(d)) - day(d) AS INT) AS days_to_month_end,
  round(dayofyear(d) / 365.25, 6) AS year_progress FROM {_DATES}""", "fact")
def calendar_features(spark, sf):
    return rounded(features.add_calendar_features(dp.facts(spark, sf).select("date").distinct()))


_CYCLES = (("dow", "isodow(d) - 1", "7"), ("month", "month(d)", "12"), ("doy", "dayofyear(d)", "365.25"), ("woy", "weekofyear(d)", "52"))


@query("SELECT d AS date, " + ", ".join(f"round({f}(2 * pi() * ({x}) / {p}), 6) + 0.0 AS {n}_{f}" for n, x, p in _CYCLES for f in ("sin", "cos")) + f" FROM {_DATES}", "fact")
def cyclical(spark, sf):
    rows = features.add_cyclical_encodings(features.add_calendar_features(dp.facts(spark, sf).select("date").distinct()))
    names = [f"{n}_{f}" for n, _, _ in _CYCLES for f in ("sin", "cos")]
    return rows.select("date", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


_WAVES = [(f, p, k, "isodow(d) - 1" if p == 7 else "dayofyear(d)") for p, n in ((7, 3), (365, 4)) for k in range(1, n + 1) for f in ("sin", "cos")]


@query("SELECT d AS date, " + ", ".join(f"round({f}(2 * pi() * {k} * ({x}) / {p}), 6) + 0.0 AS fourier_{f}_{p}_{k}" for f, p, k, x in _WAVES) + f" FROM {_DATES}", "fact")
def fourier(spark, sf):
    rows = features.add_fourier_features(features.add_calendar_features(dp.facts(spark, sf).select("date").distinct()))
    return rows.select("date", *[(F.round(f"fourier_{f}_{p}_{k}", 6) + 0.0).alias(f"fourier_{f}_{p}_{k}") for f, p, k, _ in _WAVES])


@query(f"""SELECT d AS date, CAST(greatest(d - DATE '{dp.SPECIAL_EVENT}', 0) AS INT) AS days_since_event, CAST(d - DATE '{dp.SPECIAL_EVENT}' BETWEEN 0 AND 14 AS INT) AS is_event_period,
  CAST(d - DATE '{dp.SPECIAL_EVENT}' BETWEEN 15 AND 56 AS INT) AS is_event_recovery FROM {_DATES}""", "fact")
def special_event(spark, sf):
    return features.add_special_event_features(dp.facts(spark, sf).select("date").distinct(), dp.SPECIAL_EVENT, "event")


# Windows

@query("SELECT date, store_nbr, family, " + ", ".join(f"lag(sales, {k}) OVER w AS sales_lag_{k}" for k in features.SALES_LAGS) + f" FROM panel {W}", "panel")
def lags(spark, sf):
    return features.add_lag_features(dp.panel(spark, sf)).select(*KEY, *[f"sales_lag_{k}" for k in features.SALES_LAGS])


@query(f"SELECT date, store_nbr, family, lag(sales, 364) OVER w AS sales_lag_364, lag(sales, 365) OVER w AS sales_lag_365 FROM panel {W}", "panel")
def lag_year(spark, sf):
    return features.add_same_day_last_year_lag(dp.panel(spark, sf)).select(*KEY, "sales_lag_364", "sales_lag_365")


_ROLL = [(n, s, f) for n in (7, 14, 28, 56) for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]


@query("SELECT date, store_nbr, family, " + ", ".join(f"round({f}(sales) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS sales_rolling_{s}_{n}" for n, s, f in _ROLL) + f" FROM panel {W}", "panel")
def rolling_stats(spark, sf):
    return rounded(features.add_rolling_features(dp.panel(spark, sf)).select(*KEY, *[f"sales_rolling_{s}_{n}" for n, s, _ in _ROLL]))


_SPANS = (7, 14, 28)


def _ewm_sql() -> str:
    b = {s: 1 - 2 / (s + 1) for s in _SPANS}
    weights = ", ".join(f"pow({b[s]!r}, n / 2.0 - i) AS w{s}" for s in _SPANS)
    outs = ", ".join(f"round(sum(sales * w{s}) OVER p / sum(w{s}) OVER p, 6) AS sales_ewm_{s}" for s in _SPANS)
    return f"""SELECT date, store_nbr, family, {outs} FROM (SELECT *, {weights} FROM (SELECT *, count(*) OVER (PARTITION BY store_nbr, family) AS n, row_number() OVER w AS i FROM panel {W}))
      WINDOW p AS (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(_ewm_sql(), "panel")
def ewm(spark, sf):
    return rounded(features.add_ewm_features(dp.panel(spark, sf)).select(*KEY, *[f"sales_ewm_{s}" for s in _SPANS]))


@query(f"""SELECT date, store_nbr, family, is_zero, coalesce(lag(is_zero, 1) OVER w, 1) AS was_zero_lag1, coalesce(lag(is_zero, 7) OVER w, 1) AS was_zero_lag7,
  round(avg(is_zero) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS zero_ratio_7d, round(avg(is_zero) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS zero_ratio_28d
  FROM (SELECT *, CAST(sales = 0 AS INT) AS is_zero FROM panel) {W}""", "panel")
def zero_ratio(spark, sf):
    return rounded(features.add_zero_inflation_features(dp.panel(spark, sf)).select(*KEY, "is_zero", "was_zero_lag1", "was_zero_lag7", "zero_ratio_7d", "zero_ratio_28d"))


@query(f"""SELECT date, store_nbr, family, CAST(sum(z) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS days_since_nonzero
  FROM (SELECT *, coalesce(lag(CAST(sales = 0 AS INT), 1) OVER w, 1) AS z FROM panel {W}) {W}""", "panel")
def zero_cumsum(spark, sf):
    return features.add_zero_inflation_features(dp.panel(spark, sf)).select(*KEY, "days_since_nonzero")


@query(f"""SELECT date, store_nbr, family, CAST(sum(CAST(sales = 0 AS INT)) OVER (PARTITION BY store_nbr, family, island ORDER BY date) AS BIGINT) AS zero_streak
  FROM (SELECT *, sum(CAST(sales != 0 AS INT)) OVER w AS island FROM panel {W})""", "panel")
def zero_streak(spark, sf):
    return temporal.add_zero_streak(dp.panel(spark, sf)).select(*KEY, "zero_streak")


@query("""SELECT date, store_nbr, family, CAST(age AS INT) AS days_since_first_sale, CAST(age <= 30 AS INT) AS is_new_series FROM (
  SELECT *, coalesce(greatest(date - min(CASE WHEN sales > 0 THEN date END) OVER (PARTITION BY store_nbr, family), 0), 0) AS age FROM panel)""", "panel")
def days_since_first_sale(spark, sf):
    return features.add_new_series_features(dp.panel(spark, sf)).select(*KEY, "days_since_first_sale", "is_new_series")


@query(f"""SELECT date, store_nbr, family, has_promo, round(ln(1 + onpromotion), 6) AS onpromotion_log1p, l1 AS promo_lag_1, lag(onpromotion, 7) OVER w AS promo_lag_7, lag(onpromotion, 14) OVER w AS promo_lag_14,
  CAST(coalesce(lag(onpromotion, 7) OVER w > 0, false) AS INT) AS was_promoted_last_week, onpromotion - l1 AS promo_change, s7 AS promo_rolling_sum_7, s14 AS promo_rolling_sum_14, s28 AS promo_rolling_sum_28,
  round(onpromotion / (s28 / 28.0 + 1), 6) AS promo_intensity FROM (
    SELECT *, lag(onpromotion) OVER w AS l1, {", ".join(f"CAST(sum(has_promo) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS BIGINT) AS s{n}" for n in (7, 14, 28))}
    FROM (SELECT *, CAST(onpromotion > 0 AS INT) AS has_promo FROM panel) {W}) {W}""", "panel")
def promo_features(spark, sf):
    names = ("has_promo", "onpromotion_log1p", "promo_lag_1", "promo_lag_7", "promo_lag_14", "was_promoted_last_week", "promo_change", "promo_rolling_sum_7", "promo_rolling_sum_14", "promo_rolling_sum_28", "promo_intensity")
    return rounded(features.add_promotion_features(dp.panel(spark, sf)).select(*KEY, *names))


_OIL = [f"oil_lag_{k}" for k in (1, 7, 14, 28)]
_OIL_ROLL = [(n, s, f) for n in (7, 14, 28) for s, f in (("mean", "avg"), ("std", "stddev_samp"))]


@query("SELECT date, " + ", ".join(f"lag(dcoilwtico, {k}) OVER o AS oil_lag_{k}" for k in (1, 7, 14, 28)) + ", "
       + ", ".join(f"round(dcoilwtico / nullif(lag(dcoilwtico, {k}) OVER o, 0) - 1, 6) AS oil_change_{k}d" for k in (1, 7, 28)) + ", "
       + ", ".join(f"round({f}(dcoilwtico) OVER (o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 4) AS oil_rolling_{s}_{n}" for n, s, f in _OIL_ROLL)
       + """, round((dcoilwtico - avg(dcoilwtico) OVER (o ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)) / (stddev_samp(dcoilwtico) OVER (o ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) + 1), 5) AS oil_deviation_28d
  FROM filled WINDOW o AS (ORDER BY date)""", "filled")
def oil_features(spark, sf):
    dates = panel.filled_prices(dp.facts(spark, sf), dp.prices(spark, sf))
    digits = {f"oil_change_{k}d": 6 for k in (1, 7, 28)} | {f"oil_rolling_{s}_{n}": 4 for n, s, _ in _OIL_ROLL} | {"oil_deviation_28d": 5}
    return features.oil_features(dates).select("date", *_OIL, *[F.round(c, n).alias(c) for c, n in digits.items()])


# Encodings and groups

@query(f"""SELECT p.date, p.store_nbr, p.family, {", ".join(f"round(coalesce({c}.e, g.m), 6) AS {c}_target_enc" for c in features.ENCODED)} FROM master p CROSS JOIN (SELECT avg(sales) AS m FROM master) g """
       + " ".join(f"""LEFT JOIN (SELECT {c}, (sum(sales) + 10 * (SELECT avg(sales) FROM master)) / (count(*) + 10) AS e FROM master WHERE date < DATE '{dp.ENCODE_BEFORE}' GROUP BY {c}) AS {c} ON {c}.{c} = p.{c}"""
                  for c in features.ENCODED), "master")
def target_encoding(spark, sf):
    return rounded(features.add_target_encoding(dp.master(spark, sf), before=dp.ENCODE_BEFORE).select(*KEY, *[f"{c}_target_enc" for c in features.ENCODED]))


@query("""SELECT p.date, p.store_nbr, p.family, a.l1 AS store_daily_total_lag1, a.l7 AS store_daily_total_lag7, b.l1 AS family_daily_total_lag1, b.l7 AS family_daily_total_lag7 FROM panel p
  JOIN (SELECT date, store_nbr, lag(s, 1) OVER x AS l1, lag(s, 7) OVER x AS l7 FROM (SELECT date, store_nbr, sum(sales) AS s FROM panel GROUP BY 1, 2) WINDOW x AS (PARTITION BY store_nbr ORDER BY date)) a ON a.date = p.date AND a.store_nbr = p.store_nbr
  JOIN (SELECT date, family, lag(s, 1) OVER x AS l1, lag(s, 7) OVER x AS l7 FROM (SELECT date, family, sum(sales) AS s FROM panel GROUP BY 1, 2) WINDOW x AS (PARTITION BY family ORDER BY date)) b ON b.date = p.date AND b.family = p.family""", "panel")
def store_family_aggregates(spark, sf):
    return features.add_store_family_aggregates(dp.panel(spark, sf)).select(*KEY, "store_daily_total_lag1", "store_daily_total_lag7", "family_daily_total_lag1", "family_daily_total_lag7")


#: Families of the panel are renamed to these in turn: all names that have a group, and one that has none.
_GROUPED = sorted(f for families in features.FAMILY_GROUPS.values() for f in families) + ["NO SUCH FAMILY"]


@query(f"""SELECT DISTINCT store_nbr, n.family, CASE type WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 WHEN 'E' THEN 1 ELSE 3 END AS store_type_num, coalesce(g.name, 'OTHER') AS family_group
  FROM master m JOIN (SELECT family AS old, [{", ".join(f"'{f}'" for f in _GROUPED)}][CAST((row_number() OVER (ORDER BY family) - 1) % {len(_GROUPED)} + 1 AS INT)] AS family FROM (SELECT DISTINCT family FROM master)) n
  ON m.family = n.old LEFT JOIN (VALUES {", ".join(f"('{f}', '{g}')" for g, families in features.FAMILY_GROUPS.items() for f in families)}) g(family, name) ON g.family = n.family""", "master")
def family_group_map(spark, sf):
    rows = dp.master(spark, sf).select("store_nbr", "family", "type").distinct()
    place = F.row_number().over(temporal.Window.partitionBy(F.lit(1)).orderBy("family"))
    names = rows.select("family").distinct().select(F.col("family").alias("old"), F.element_at(F.lit(_GROUPED), ((place - 1) % len(_GROUPED) + 1).cast("int")).alias("new"))
    renamed = rows.join(names, F.col("family") == F.col("old")).withColumn("family", F.col("new"))
    return features.add_store_family_features(renamed).select("store_nbr", "family", "store_type_num", "family_group").distinct()


#: The features by the query that gives them with its SQL: of a date, or of a row.
_BY_DATE = {
    "holiday_distance": ["days_to_holiday", "days_since_holiday"],
    "calendar_features": ["day_of_month_cos", "day_of_month_sin", "days_in_month", "days_since_month_start", "days_to_month_end", "days_to_payday", "is_payday", "quarter", "year_progress"],
    "cyclical": [f"{c}_{f}" for c in ("dow", "month", "doy", "woy") for f in ("sin", "cos")],
    "fourier": [f"fourier_{f}_{p}_{k}" for f, p, k, _ in _WAVES],
    "oil_features": [f"oil_lag_{k}" for k in (1, 7, 14, 28)] + [f"oil_change_{k}d" for k in (1, 7, 28)] + [f"oil_rolling_{f}_{n}" for f in ("mean", "std") for n in (7, 14, 28)] + ["oil_deviation_28d"],
}
_BY_ROW = {
    "holiday_flags": list(_FLAGS),
    "lags": [f"sales_lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28, 56)],
    "lag_year": ["sales_lag_364", "sales_lag_365"],
    "rolling_stats": [f"sales_rolling_{f}_{n}" for f in ("mean", "std", "min", "max") for n in (7, 14, 28, 56)],
    "ewm": [f"sales_ewm_{n}" for n in (7, 14, 28)],
    "zero_ratio": ["is_zero", "was_zero_lag1", "was_zero_lag7", "zero_ratio_7d", "zero_ratio_28d"],
    "zero_cumsum": ["days_since_nonzero"],
    "days_since_first_sale": ["days_since_first_sale", "is_new_series"],
    "promo_features": ["has_promo", "onpromotion_log1p", "promo_change", "promo_intensity", "was_promoted_last_week"] + [f"promo_lag_{k}" for k in (1, 7, 14)] + [f"promo_rolling_sum_{n}" for n in (7, 14, 28)],
    "target_encoding": [f"{c}_target_enc" for c in ("store_nbr", "family", "city", "state", "cluster")],
    "store_family_aggregates": [f"{k}_daily_total_lag{n}" for k in ("store", "family") for n in (1, 7)],
}


def _all_features_sql() -> str:
    """The SQL of every family of features, joined by date or by date and series."""
    base = with_base("SELECT * FROM master", "master")
    columns = [f"m.{c}" for c in MASTER if c != "dcoilwtico"] + ["round(m.dcoilwtico, 6) AS dcoilwtico"] + [f"{q}.{c}" for q, names in (_BY_DATE | _BY_ROW).items() for c in names]
    columns += [f"special_event.{c}_event{x} AS {c}_earthquake{x}" for c, x in (("days_since", ""), ("is", "_period"), ("is", "_recovery"))]
    columns += ["CASE m.type WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 WHEN 'E' THEN 1 ELSE 3 END AS store_type_num", "'OTHER' AS family_group"]
    joins = [f"JOIN ({ORACLE_SQL[q]}) AS {q} ON {q}.date = m.date" for q in (*_BY_DATE, "special_event")]
    joins += [f"JOIN ({ORACLE_SQL[q]}) AS {q} ON {q}.date = m.date AND {q}.store_nbr = m.store_nbr AND {q}.family = m.family" for q in _BY_ROW]
    return f"SELECT {', '.join(columns)} FROM ({base}) AS m {' '.join(joins)}"


@query(_all_features_sql())
def all_features(spark, sf):
    rows = features.create_all_features(dp.master(spark, sf), dp.SPECIAL_EVENT, dp.ENCODE_BEFORE)
    digits = {c: 4 if c.startswith("oil_rolling") else 5 if c.startswith("oil_deviation") else 6 for c, k in rows.dtypes if k in ("double", "float")}
    return rows.withColumns({c: F.round(c, n) + 0.0 for c, n in digits.items()})


# Exploration

@query("""SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_days, count(DISTINCT store_nbr) AS n_stores, count(DISTINCT family) AS n_families, count(*) AS total_rows,
  round(avg(CAST(sales = 0 AS INT)), 6) AS zero_sales_ratio FROM panel""", "panel")
def basic_stats(spark, sf):
    return rounded(eda.get_basic_stats(dp.panel(spark, sf)))


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in MASTER) + " FROM master", "master")
def null_counts(spark, sf):
    return eda.null_counts(dp.master(spark, sf).select(*MASTER))


@query("""SELECT family, round_even(avg(CAST(sales = 0 AS INT)), 4) AS zero_ratio, round_even(coalesce(avg(sales) FILTER (sales > 0), 0), 4) AS mean_when_nonzero, count(*) AS count FROM panel GROUP BY family""", "panel")
def zero_by_family(spark, sf):
    return eda.analyze_zero_sales(dp.panel(spark, sf))


@query("""SELECT *, zero_ratio > 0.9 AS is_sparse FROM (SELECT store_nbr, family, round_even(avg(CAST(sales = 0 AS INT)), 4) AS zero_ratio, sum(sales) AS total_sales, count(*) AS n_days FROM panel GROUP BY 1, 2)""", "panel")
def sparse_series(spark, sf):
    return eda.analyze_store_family_combinations(dp.panel(spark, sf))


@query(f"SELECT {r(('mean', 'median', 'std', 'min', 'max', 'skewness', 'kurtosis'), 5)} FROM (SELECT avg(sales) AS mean, median(sales) AS median, stddev_samp(sales) AS std, min(sales) AS min, max(sales) AS max, skewness(sales) AS skewness, kurtosis(sales) AS kurtosis FROM panel)", "panel")
def sales_distribution(spark, sf):
    return rounded(eda.sales_distribution(dp.panel(spark, sf)), 5)


@query("SELECT family, round_even(avg(sales), 2) AS mean, round_even(median(sales), 2) AS median, round_even(stddev_samp(sales), 2) AS std, min(sales) AS min, max(sales) AS max FROM panel GROUP BY family", "panel")
def family_stats(spark, sf):
    return eda.family_distribution(dp.panel(spark, sf))


@query("""SELECT bin, round(a + (bin - 1) * w, 6) AS low, round(a + bin * w, 6) AS high, count(*) AS n FROM (
  SELECT CAST(least(floor((sales - a) / w) + 1, 100) AS INT) AS bin, a, w FROM panel CROSS JOIN (SELECT min(sales) AS a, (max(sales) - min(sales)) / 100 AS w FROM panel WHERE sales > 0) WHERE sales > 0) GROUP BY bin, a, w""", "panel")
def histogram(spark, sf):
    return rounded(eda.histogram(dp.panel(spark, sf)))


@query("""SELECT family, round(avg(sales), 6) AS mean, quantile_cont(sales, 0.25) AS q25, quantile_cont(sales, 0.5) AS q50, quantile_cont(sales, 0.75) AS q75 FROM panel GROUP BY family ORDER BY avg(sales) DESC, family LIMIT 15""", "panel")
def family_boxplot(spark, sf):
    return rounded(eda.family_boxplot(dp.panel(spark, sf)))


@query("""SELECT dayofweek, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][dayofweek + 1] AS label, round(avg(sales), 6) AS mean_sales FROM master GROUP BY dayofweek""", "master")
def dow_profile(spark, sf):
    return rounded(eda.day_of_week_profile(dp.master(spark, sf)))


@query("SELECT month, round(avg(sales), 6) AS mean_sales FROM master GROUP BY month", "master")
def month_profile(spark, sf):
    return rounded(eda.month_profile(dp.master(spark, sf)))


_MONTHS = ", ".join(f"round(avg(sales) FILTER (month = {m}), 6) AS m{m}" for m in range(1, 13))


def _named_months(df: DataFrame, key: str) -> DataFrame:
    return rounded(df.select(key, *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)]))


@query(f"SELECT year, {_MONTHS} FROM master GROUP BY year", "master")
def year_month_pivot(spark, sf):
    return _named_months(eda.year_month_pivot(dp.master(spark, sf)), "year")


@query(f"SELECT dayofweek, {_MONTHS} FROM master GROUP BY dayofweek", "master")
def dow_month_pivot(spark, sf):
    return _named_months(eda.dow_month_pivot(dp.master(spark, sf)), "dayofweek")


@query(f"""SELECT family, {r(('no_promo_sales', 'promo_sales'))}, round(promo_sales / nullif(no_promo_sales, 0), 6) AS promo_lift, round((promo_sales / nullif(no_promo_sales, 0) - 1) * 100, 4) AS promo_lift_pct
  FROM (SELECT family, avg(sales) FILTER (onpromotion <= 0) AS no_promo_sales, avg(sales) FILTER (onpromotion > 0) AS promo_sales FROM panel GROUP BY family)""", "panel")
def promo_lift(spark, sf):
    out = eda.analyze_promotion_effect(dp.panel(spark, sf))
    return rounded(out.withColumn("promo_lift_pct", F.round("promo_lift_pct", 4)))


_DAILY = "(SELECT date, sum(sales) AS s, max(dcoilwtico) AS o FROM master GROUP BY date HAVING max(dcoilwtico) IS NOT NULL)"
_CORR30 = f"(SELECT date, s, o, CASE WHEN count(*) OVER x = 30 THEN nullif(corr(s, o) OVER x, 'NaN'::DOUBLE) END AS c FROM {_DAILY} WINDOW x AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"


@query(f"SELECT round(corr(s, o), 6) AS overall_corr, round(avg(c), 6) AS rolling_corr_mean, round(stddev_samp(c), 6) AS rolling_corr_std FROM {_CORR30}", "master")
def oil_corr(spark, sf):
    return rounded(eda.oil_correlation(dp.master(spark, sf)))


@query("SELECT family, round(corr(s, o), 6) AS oil_correlation FROM (SELECT date, family, sum(sales) AS s, max(dcoilwtico) AS o FROM master GROUP BY 1, 2) GROUP BY family", "master")
def oil_corr_by_family(spark, sf):
    return rounded(eda.oil_correlation_by_family(dp.master(spark, sf)))


@query(f"SELECT date, round(c, 5) AS rolling_corr FROM {_CORR30}", "master")
def rolling_corr(spark, sf):
    return rounded(eda.rolling_oil_correlation(dp.master(spark, sf)), 5)


@query("""SELECT round(avg(sales) FILTER (NOT is_holiday), 6) AS normal_day_sales, round(avg(sales) FILTER (is_holiday), 6) AS holiday_sales, round(avg(sales) FILTER (is_holiday) / avg(sales) FILTER (NOT is_holiday), 6) AS holiday_lift,
  round(avg(sales) FILTER (NOT is_national_holiday), 6) AS not_national_sales, round(avg(sales) FILTER (is_national_holiday), 6) AS national_holiday_sales FROM master""", "master")
def holiday_effect(spark, sf):
    return rounded(eda.analyze_holiday_effect(dp.master(spark, sf)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS level, CAST({c} AS VARCHAR) AS value, round(avg(sales), 6) AS mean, sum(sales) AS sum, count(*) AS count FROM master GROUP BY {c}" for c in eda.STORE_LEVELS), "master")
def store_patterns(spark, sf):
    return rounded(eda.analyze_store_patterns(dp.master(spark, sf)))


@query("""SELECT date, s AS sales, round(CASE WHEN count(*) OVER x = 7 THEN avg(s) OVER x END, 6) AS ma FROM (SELECT date, sum(sales) AS s FROM panel GROUP BY date) WINDOW x AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", "panel")
def daily_ma7(spark, sf):
    return rounded(eda.daily_moving_average(dp.panel(spark, sf)))


@query("SELECT family, sum(sales) AS total_sales FROM panel GROUP BY family ORDER BY total_sales DESC, family LIMIT 10", "panel")
def top_families(spark, sf):
    return eda.top_families(dp.panel(spark, sf))


@query("SELECT date, family, sum(sales) AS sales FROM panel WHERE family IN (SELECT family FROM panel GROUP BY family ORDER BY sum(sales) DESC, family LIMIT 3) GROUP BY 1, 2", "panel")
def top_family_series(spark, sf):
    return eda.top_family_series(dp.panel(spark, sf), 3)


@query("SELECT city, sum(sales) AS total_sales FROM master GROUP BY city ORDER BY total_sales DESC, city LIMIT 10", "master")
def top_cities(spark, sf):
    return eda.top_cities(dp.master(spark, sf))


@query("SELECT count(*) FILTER (sales > 150) AS n_extreme, round(avg(CAST(sales > 150 AS INT)), 6) AS share FROM panel", "panel")
def extreme_values(spark, sf):
    return rounded(eda.extreme_values(dp.panel(spark, sf), 150))


@query("""SELECT 'sales' AS "column", count(sales) AS count, round(avg(sales), 6) AS mean, round(stddev_samp(sales), 6) AS std, min(sales) AS min, quantile_cont(sales, 0.25) AS q25, quantile_cont(sales, 0.5) AS q50, quantile_cont(sales, 0.75) AS q75, max(sales) AS max FROM panel""", "panel")
def describe_sales(spark, sf):
    return rounded(eda.describe(dp.panel(spark, sf), "sales"))


@query("""SELECT d AS date, coalesce(last_value(s IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sales FROM (SELECT unnest(generate_series((SELECT min(date) FROM fact), (SELECT max(date) FROM fact), INTERVAL 1 DAY))::DATE AS d)
  LEFT JOIN (SELECT date, sum(sales) AS s FROM fact GROUP BY date) ON date = d""", "fact")
def regular_daily(spark, sf):
    return temporal.regularize(eda.daily_totals(dp.facts(spark, sf)), "sales").select("date", "sales")


# Models: baselines, folds, slices

def last_days(rows: DataFrame, n: int = 15) -> Column:
    return F.col("date") > F.date_sub(rows.agg(F.max("date")).scalar(), n)


def forecasts(spark, sf) -> DataFrame:
    """The last 15 days with the naive forecasts."""
    known = dp.known_facts(spark, sf)
    rows = models.add_naive_baselines(dp.panel(spark, sf, known))
    return rows.withColumnRenamed("naive_last_week", "pred").where(last_days(known))


def with_interval(df: DataFrame) -> DataFrame:
    return df.withColumns({"pred_q05": F.greatest(F.col("pred") * 0.5, F.lit(0.0)), "pred_q95": F.col("pred") * 1.5})


def _metrics_sql(p: str = "pred") -> str:
    return f"""round(sqrt(avg(pow(ln(1 + greatest({p}, 0)) - ln(1 + sales), 2))), 6) AS rmsle, round(avg(abs(sales - {p})), 6) AS mae, round(avg(abs((sales - {p}) / (sales + 1))) * 100, 4) AS mape,
      round(avg({p} - sales), 6) AS bias, round(sqrt(avg(pow({p} - sales, 2))), 6) AS rmse"""


def _metric_digits(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("mape", F.round("mape", 4)))


@query("SELECT date, store_nbr, family, pred FROM oof", "oof")
def naive_last_week(spark, sf):
    return forecasts(spark, sf).select(*KEY, "pred")


@query("SELECT date, store_nbr, family, round(naive_roll_7, 6) AS naive_roll_7, round(naive_roll_28, 6) AS naive_roll_28 FROM oof", "oof")
def naive_rolling(spark, sf):
    return rounded(forecasts(spark, sf).select(*KEY, "naive_roll_7", "naive_roll_28"))


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, {_metrics_sql(c)} FROM oof" for m, c in (("naive_last_week", "pred"), ("naive_roll_7", "naive_roll_7"), ("naive_roll_28", "naive_roll_28"))), "oof")
def naive_baselines(spark, sf):
    known = dp.known_facts(spark, sf)
    return _metric_digits(models.compute_naive_baselines(dp.panel(spark, sf, known), last_days(known)))


@query(f"SELECT family, {_metrics_sql()}, count(*) AS count, round(avg(sales), 6) AS mean_actual, round(avg(CAST(sales = 0 AS INT)) * 100, 6) AS zero_pct FROM oof GROUP BY family", "oof")
def metrics_by_family(spark, sf):
    return _metric_digits(models.analyze_errors_by_group(forecasts(spark, sf), "family"))


@query(f"SELECT CAST(onpromotion > 0 AS INT) AS has_promo, {_metrics_sql()}, count(*) AS count FROM oof GROUP BY 1", "oof")
def metrics_promo(spark, sf):
    return _metric_digits(models.analyze_promotion_errors(forecasts(spark, sf).select(*KEY, "sales", "pred"), dp.panel(spark, sf)))


@query(f"SELECT sales = 0 AS is_zero, {_metrics_sql()}, count(*) AS count, round(avg(pred), 6) AS mean_pred, round(avg(CAST(pred > 0 AS INT)) * 100, 6) AS over_predict_pct FROM oof GROUP BY 1", "oof")
def metrics_zero_split(spark, sf):
    return _metric_digits(models.analyze_zero_vs_nonzero(forecasts(spark, sf)))


@query("SELECT round(sqrt(avg(pow(ln(1 + pred) - ln(1 + sales), 2))), 6) AS rmsle, round(avg(abs(sales - pred)), 6) AS mae, round(avg(abs((sales - pred) / (sales + 1))) * 100, 4) AS mape FROM oof", "oof")
def dashboard_metrics(spark, sf):
    return _metric_digits(forecasts(spark, sf).agg(*stats.dashboard_metrics(F.col("sales"), F.col("pred"))))


_FOLDS = [models.Fold(f"Fold {i}", None, dp.date(2001, a - 1, 28), dp.date(2001, a, 1), dp.date(2001, a, 15)) for i, a in enumerate((7, 8, 9), 1)]


@query(" UNION ALL ".join(f"SELECT '{f.name}' AS fold, CAST(count(*) FILTER (date <= DATE '{f.train_end}') AS BIGINT) AS train_size, CAST(count(*) FILTER (date BETWEEN DATE '{f.val_start}' AND DATE '{f.val_end}') AS BIGINT) AS val_size FROM panel" for f in _FOLDS), "panel")
def cv_folds(spark, sf):
    return models.fold_sizes(dp.panel(spark, sf), _FOLDS)


@query("""SELECT fold, d[1] AS train_start, d[n - fold * 16] AS train_end, d[n - fold * 16 + 1] AS val_start, d[n - fold * 16 + 16] AS val_end FROM (SELECT list_sort(list(DISTINCT date)) AS d, count(DISTINCT date) AS n FROM fact), (VALUES (1), (2), (3)) AS v(fold)""", "fact")
def cv_fold_generator(spark, sf):
    folds = models.TimeSeriesFoldGenerator(3, 16).split(dp.facts(spark, sf))
    return spark.createDataFrame([(int(f.name.split()[1]), f.train_start, f.train_end, f.val_start, f.val_end) for f in folds], "fold int, train_start date, train_end date, val_start date, val_end date")


# Hierarchy

@query("SELECT level, count(DISTINCT series_id) AS n_series FROM levels GROUP BY level", "levels")
def hierarchy_levels(spark, sf):
    return hierarchy.get_hierarchy_levels(dp.facts(spark, sf))


@query("SELECT date, level, series_id, sales, pred FROM levels", "levels")
def bottom_up(spark, sf):
    return hierarchy.aggregate_all_levels(forecasts(spark, sf), ["sales", "pred"]).select("date", "level", "series_id", "sales", "pred")


@query("""SELECT o.date, o.store_nbr, o.family, round(t.t * p.p, 6) AS pred FROM oof o JOIN (SELECT date, sum(pred) AS t FROM oof GROUP BY date) t ON t.date = o.date JOIN (
  SELECT store_nbr, family, avg(sales / CASE WHEN t = 0 THEN 1 ELSE t END) AS p FROM (SELECT *, sum(sales) OVER (PARTITION BY date) AS t FROM oof) GROUP BY 1, 2) p ON p.store_nbr = o.store_nbr AND p.family = o.family""", "oof")
def top_down(spark, sf):
    rows = forecasts(spark, sf)
    model = hierarchy.TopDown().fit(rows)
    return rounded(model.reconcile(rows, rows.groupBy("date").agg(F.sum("pred").alias("pred"))))


def independent_base(spark, sf) -> DataFrame:
    """The last 15 days with a base forecast of its own for every level, so that levels don't add up."""
    def over(*k):
        return F.sum("naive_roll_28").over(temporal.Window.partitionBy("date", *k))

    return forecasts(spark, sf).select(*KEY, "sales", F.col("pred").alias("base_bottom"), (1.1 * over("store_nbr")).alias("base_store"), (0.9 * over("family")).alias("base_family"),
                                       F.sum("naive_roll_7").over(temporal.Window.partitionBy("date")).alias("base_total"))


def _mint_sql(ols: bool) -> str:
    n_s, n_f = "ns", "nf"
    c = ("1.0", "1.0", "1.0", f"(1.0 + {n_s}) * (1 + {n_f})", f"(1.0 + {n_f})", f"(1.0 + {n_s})") if ols else (f"1.0 / {n_f}", f"1.0 / {n_s}", f"1.0 / ({n_s} * {n_f})", "4.0", "2.0", "2.0")
    return f"""SELECT date, store_nbr, family, round(m / e0 + (ms - m) / es + (mf - m) / ef + (z - ms - mf + m), {4 if ols else 6}) AS reconciled FROM (
      SELECT *, avg(z) OVER (PARTITION BY date) AS m, avg(z) OVER (PARTITION BY date, store_nbr) AS ms, avg(z) OVER (PARTITION BY date, family) AS mf FROM (
        SELECT *, base_bottom + {c[0]} * base_store + {c[1]} * base_family + {c[2]} * base_total AS z, {c[3]} AS e0, {c[4]} AS es, {c[5]} AS ef
        FROM grid JOIN (SELECT date AS dd, count(DISTINCT store_nbr) AS ns, count(DISTINCT family) AS nf FROM grid GROUP BY date) ON dd = date))"""


@query(_mint_sql(True), "grid")
def mintrace_ols(spark, sf):
    return rounded(hierarchy.reconcile_min_trace(independent_base(spark, sf), "ols").select(*KEY, "reconciled"), 4)


@query(_mint_sql(False), "grid")
def mintrace_wls(spark, sf):
    return rounded(hierarchy.reconcile_min_trace(independent_base(spark, sf), "wls_struct").select(*KEY, "reconciled"), 6)


@query("""SELECT 'independent' AS forecasts, bool_and(abs(t - s) < 1e-6 AND abs(t - f) < 1e-6 AND abs(t - b) < 1e-6) AS is_coherent, round(max(abs(t - s)), 3) AS max_store_diff,
    round(max(abs(t - f)), 3) AS max_family_diff, round(max(abs(t - b)), 3) AS max_bottom_diff
  FROM (SELECT date, max(base_total) AS t, sum(base_bottom) AS b FROM grid GROUP BY date)
  JOIN (SELECT date, sum(v) AS s FROM (SELECT date, max(base_store) AS v FROM grid GROUP BY date, store_nbr) GROUP BY date) USING (date)
  JOIN (SELECT date, sum(v) AS f FROM (SELECT date, max(base_family) AS v FROM grid GROUP BY date, family) GROUP BY date) USING (date)
  UNION ALL SELECT 'reconciled', true, 0e0, 0e0, 0e0""", "grid")
def coherence(spark, sf):
    """Forecasts of every level on its own, which don't add up, and reconciled ones, which do."""
    rows = independent_base(spark, sf)
    levels = [rows.groupBy("date", *keys).agg(F.max(f"base_{level.lower()}").alias("pred")).select("date", F.lit(level).alias("level"), "pred")
              for level, keys in (("Total", ()), ("Store", ("store_nbr",)), ("Family", ("family",)), ("Bottom", ("store_nbr", "family")))]
    apart = hierarchy.evaluate_coherence(levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3]), "pred")
    joined = hierarchy.evaluate_coherence(hierarchy.reconcile_forecasts(forecasts(spark, sf)), "pred_MinTrace_ols")
    return rounded(apart.select(F.lit("independent").alias("forecasts"), "*").unionByName(joined.select(F.lit("reconciled").alias("forecasts"), "*")), 3)


@query(" UNION ALL ".join(f"SELECT level, '{m}' AS method, round(sqrt(avg(pow(ln(1 + greatest(pred, 0)) - ln(1 + greatest(sales, 0)), 2))), 6) AS rmsle, count(DISTINCT series_id) AS n_series, count(*) AS n_obs FROM levels GROUP BY level" for m in ("base", "BottomUp", "MinTrace_ols")), "levels")
def rmsle_by_level(spark, sf):
    return rounded(hierarchy.evaluate_at_levels(hierarchy.reconcile_forecasts(forecasts(spark, sf))))


@query()
def mint_shrink(spark, sf):
    rows = forecasts(spark, sf)
    base = hierarchy.aggregate_all_levels(rows, ["pred"]).withColumnRenamed("pred", "value")
    residuals = hierarchy.aggregate_all_levels(rows.withColumn("value", F.col("sales") - F.col("pred")), ["value"])
    return hierarchy.mint_shrink(base.select("date", "level", "series_id", "value"), residuals.select("date", "series_id", "value"))


# Business

@query("SELECT date, series_id, sales, pred AS pred_BottomUp, pred - sales AS error, round_even((pred - sales) / (sales + 1) * 100, 1) AS error_pct FROM levels WHERE level = 'Store'", "levels")
def drilldown_error(spark, sf):
    rows = hierarchy.aggregate_all_levels(forecasts(spark, sf), ["sales", "pred"]).withColumnRenamed("pred", "pred_BottomUp")
    return business.drilldown(rows, "Store").select("date", "series_id", "sales", "pred_BottomUp", "error", "error_pct")


@query("""SELECT sum(sales) FILTER (level = 'Total') AS total_actual, sum(pred) FILTER (level = 'Total') AS total_forecast, count(DISTINCT series_id) FILTER (level = 'Bottom') AS n_bottom,
  round((sum(pred) FILTER (level = 'Total') - sum(sales) FILTER (level = 'Total')) / sum(sales) FILTER (level = 'Total') * 100, 6) AS delta_pct FROM levels""", "levels")
def overview(spark, sf):
    rows = hierarchy.aggregate_all_levels(forecasts(spark, sf), ["sales", "pred"]).withColumnRenamed("pred", "pred_BottomUp")
    return rounded(business.overview(rows))


@query(f"""SELECT family, round(sum(pred), 6) AS baseline, round(sum(pred) * {1 + (business.AVERAGE_ELASTICITY - 1) * 0.5!r}::DOUBLE, 4) AS simulated, round(sum(pred) * {(business.AVERAGE_ELASTICITY - 1) * 0.5!r}::DOUBLE, 4) AS delta,
  round(CASE WHEN sum(pred) = 0 THEN 0e0 ELSE {(business.AVERAGE_ELASTICITY - 1) * 50!r}::DOUBLE END, 4) AS delta_pct FROM oof GROUP BY family""", "oof")
def what_if(spark, sf):
    out = business.what_if_totals(business.what_if(with_interval(forecasts(spark, sf)), 0.5), "family")
    return rounded(out, 4)


@query("""SELECT date, round(sum(greatest(pred_q95 * 1.1 - sales, 0)), 4) AS overstock_cost, round(sum(greatest(sales - pred_q95 * 1.1, 0)) * 5, 4) AS stockout_cost, round(sum(greatest(pred_q95 * 1.1 - sales, 0) + 5 * greatest(sales - pred_q95 * 1.1, 0)), 4) AS total_cost,
  round(sum(greatest(pred - sales, 0) + 5 * greatest(sales - pred, 0)), 4) AS total_cost_naive FROM forecast GROUP BY date""", "forecast")
def inventory_cost(spark, sf):
    return rounded(business.cost_by_date(business.inventory_cost(with_interval(forecasts(spark, sf)))), 4)


@query("SELECT round(avg(CAST(sales BETWEEN pred_q05 AND pred_q95 AS INT)) * 100, 6) AS coverage_pct FROM forecast", "forecast")
def interval_coverage(spark, sf):
    return rounded(business.cost_summary(business.inventory_cost(with_interval(forecasts(spark, sf)))).select("coverage_pct"))


# Models that SQL can't express

def _model_rows(spark, sf) -> DataFrame:
    """Features of the whole panel, which the folds' expanding windows cut."""
    rows = features.add_calendar_features(dp.panel(spark, sf))
    return features.add_promotion_features(features.add_rolling_features(features.add_lag_features(rows, lags=(1, 7, 14)), windows=(7, 28)))


_MODEL_FEATURES = ["dayofweek", "month", "day", "is_weekend", "store_nbr", "onpromotion", "has_promo", "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_rolling_mean_7", "sales_rolling_mean_28", "promo_lag_7"]


def _folds(rows: DataFrame) -> list[models.Fold]:
    """The two half-months before the last date, the later one last."""
    last = rows.agg(F.max("date").alias("d")).first()["d"]
    day = models.timedelta(days=1)
    return [models.Fold(f"Fold {i}", None, last - 15 * k * day, last - (15 * k - 1) * day, last - 15 * (k - 1) * day) for i, k in ((1, 2), (2, 1))]


def _cv(spark, sf):
    rows = _model_rows(spark, sf)
    return models.run_cv(rows, _folds(rows), features=_MODEL_FEATURES)


@query()
def gbt_cv(spark, sf):
    return _cv(spark, sf)[0]


@query()
def feature_importance(spark, sf):
    return models.feature_importance(spark, _cv(spark, sf)[1])


@query()
def quantile_intervals(spark, sf):
    oof = _cv(spark, sf)[2]
    residuals = models.fit_residual_quantiles(oof.where("fold = 'Fold 1'"))
    return models.predict_quantiles(oof.where("fold = 'Fold 2'"), residuals).select(*KEY, "sales", "pred", "pred_q05", "pred_q50", "pred_q95")


#: Trees of the registered leaf-wise queries; the library's own numbers are in ``leafwise_params`` and ``quantile_params``.
_TREES = 5


def _leafwise(spark, sf):
    rows = stage(_model_rows(spark, sf), "model-rows")
    return models.run_cv_leafwise(rows, _folds(rows), features=_MODEL_FEATURES, params=models.leafwise_params(max_iter=_TREES), early_fraction=0.0)


@query()
def leafwise_cv(spark, sf):
    return _leafwise(spark, sf)[0]


@query()
def leafwise_importance(spark, sf):
    return models.leafwise_importance(spark, _leafwise(spark, sf)[1])


@query()
def quantile_boosting(spark, sf):
    """The last half-month with quantiles of models trained on all days before it."""
    rows = stage(_model_rows(spark, sf), "model-rows")
    fold = _folds(rows)[1]
    fitted = models.train_quantile_models(rows, F.col("date") <= F.lit(fold.train_end), features=_MODEL_FEATURES, params=boosting.quantile_params(max_iter=_TREES))
    return models.predict_leafwise(fitted, fold.validation(rows)).select(*KEY, "sales", "pred_q05", "pred_q50", "pred_q95")


@query()
def stl_strength(spark, sf):
    return perform_stl_decomposition(dp.panel(spark, sf))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the seven-day naive forecast per family: scan, joins, densification, windows, aggregates."""
    return metrics_by_family(spark, sf_dir)
