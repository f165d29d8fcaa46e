"""Small inputs with results worked out by hand."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from saleslens.functions import stats
from saleslens.operators import business, eda, features, hierarchy, models, panel, temporal

DAY = date(2024, 1, 1)


def panel_of(spark, series, **extra):
    rows = [(DAY + timedelta(days=i), s, "F", float(v), 0) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, onpromotion int")


def by_series(df, column):
    out = {}
    for r in df.orderBy("store_nbr", "date").collect():
        out.setdefault(r.store_nbr, []).append(r[column])
    return list(out.values())


def test_rolling_and_ewm_stay_in_their_series(spark):
    df = panel_of(spark, {1: [1, 2, 3], 2: [10, 20, 30]})
    assert by_series(features.add_rolling_features(df, windows=(2,)), "sales_rolling_mean_2") == [[None, 1, 1.5], [None, 10, 15]]
    assert by_series(features.add_rolling_features(df, windows=(2,)), "sales_rolling_std_2")[0][1] is None
    got = by_series(features.add_ewm_features(df, spans=(3,)), "sales_ewm_3")
    assert got[0][:2] == [None, 1] and got[0][2] == pytest.approx(5 / 3) and got[1][2] == pytest.approx(50 / 3)


def test_paydays_and_weekdays(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 14, 15, 31)] + [(date(2024, 1, 7),), (date(2021, 1, 3),)], "date date")
    got = {r.date: r for r in features.add_calendar_features(days).collect()}
    assert [got[date(2024, 1, d)].days_to_payday for d in (1, 14, 15, 31)] == [1, 1, 0, 0]
    assert [got[date(2024, 1, d)].is_payday for d in (1, 14, 15, 31)] == [False, False, True, True]
    assert got[date(2024, 1, 7)].dayofweek == 6 and got[date(2021, 1, 3)].weekofyear == 53


def test_holiday_distances(spark):
    days = spark.createDataFrame([(date(2024, 1, d), d == 5) for d in range(1, 11)], "date date, h boolean")
    plain = temporal.event_distances(days, F.col("h"))
    names = [c for c in plain.columns if c not in ("date", "h")]
    assert names
    rows = plain.orderBy("date").collect()
    assert [4, 3, 2, 1, 0, 30, 30, 30, 30, 30] in [[r[c] for r in rows] for c in names]
    assert [30, 30, 30, 30, 0, 1, 2, 3, 4, 5] in [[r[c] for r in rows] for c in names]


def test_events_of_one_day_become_one_row(spark):
    rows = [(0, DAY, "Holiday", "National", "a", False), (1, DAY, "Event", "Local", "b", False)]
    got = panel.process_holidays(spark.createDataFrame(rows, "ord int, date date, type string, locale string, description string, transferred boolean"), "ord").collect()
    assert len(got) == 1 and got[0].holiday_type == "Holiday,Event" and got[0].is_national_holiday and got[0].is_local_holiday


def test_price_gaps(spark):
    days = spark.createDataFrame([(DAY + timedelta(days=i),) for i in range(4)], "date date")
    oil = spark.createDataFrame([(DAY + timedelta(days=1), 50.0), (DAY + timedelta(days=2), None), (DAY + timedelta(days=3), 52.0)], "date date, dcoilwtico double")
    assert [r.dcoilwtico for r in panel.filled_prices(days, oil).orderBy("date").collect()] == [50, 50, 50, 52]


def test_zeros(spark):
    df = panel_of(spark, {1: [0, 0, 5, 0]})
    assert by_series(features.add_zero_inflation_features(df), "days_since_nonzero") == [[1, 2, 3, 3]]
    assert by_series(features.add_zero_inflation_features(df), "was_zero_lag1")[0][0] == 1
    assert by_series(temporal.add_zero_streak(df), "zero_streak") == [[1, 2, 0, 1]]
    never = features.add_new_series_features(panel_of(spark, {1: [0, 0]})).collect()
    assert all(r.days_since_first_sale == 0 and r.is_new_series == 1 for r in never)


def test_measures(spark):
    one = spark.createDataFrame([(0.0, -1.0)], "y double, p double")
    assert one.select(stats.rmsle(F.col("y"), F.col("p"))).first()[0] == 0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert flat.agg(stats.pearson("a", "b")).first()[0] is None


def test_folds(spark):
    def folds(n, **kw):
        days = [DAY + timedelta(days=i) for i in range(n)]
        df = spark.createDataFrame([(d,) for d in days], "date date")
        return [(days.index(f.val_start) + 1, days.index(f.val_end) + 1) for f in models.TimeSeriesFoldGenerator(3, 16, **kw).split(df)]

    assert folds(400) == [(385, 400), (369, 384)] and folds(420)[2] == (373, 388)
    assert folds(370) == [] and folds(400, min_train_days=300)[2] == (353, 368)


def test_hierarchy_adds_up(spark):
    rows = [(DAY, s, f, float(10 * s + i), float(s + i)) for s in (1, 2) for i, f in enumerate(("A", "B", "C"))]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, pred double")
    got = {(r.level, r.series_id): r.pred for r in hierarchy.aggregate_all_levels(df, ["sales", "pred"]).collect()}
    total = [v for (level, _), v in got.items() if level == "Total"][0]
    for level in ("Store", "Family", "Bottom"):
        assert sum(v for (n, _), v in got.items() if n == level) == total == 15
    back = hierarchy.reconcile_forecasts(df)
    assert all(abs(r["pred_MinTrace_ols"] - r["pred_BottomUp"]) < 1e-9 for r in back.collect())


def test_what_if_and_inventory(spark):
    rows = spark.createDataFrame([(DAY, 1, "X", 12.0, 10.0, 5.0, 10.0)], "date date, store_nbr int, family string, sales double, pred double, pred_q05 double, pred_q95 double")
    assert 10 * (1 + (business.AVERAGE_ELASTICITY - 1) * 0.5) == pytest.approx(35.9)
    cost = business.cost_by_date(business.inventory_cost(rows)).first()
    assert cost.stockout_cost == pytest.approx(5.0) and cost.overstock_cost == 0


def test_basic_stats_of_nothing(spark):
    assert eda.get_basic_stats(panel_of(spark, {1: [1]}).limit(0)).first().total_rows == 0
