"""Feature families.  Each takes and returns a panel; features of a date alone are computed once per date and broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, cyclical_columns, event_columns, fourier_columns
from ..functions.text import mentions
from ..sources.staging import stage
from . import temporal as t

KEYS = t.KEYS

# Store types and product groups.
STORE_TYPES = {"A": 5, "B": 4, "C": 3, "D": 2, "E": 1}
FAMILY_GROUPS = {
    "GROCERY": ("GROCERY I", "GROCERY II"),
    "BEVERAGES": ("BEVERAGES",),
    "PRODUCE": ("PRODUCE",),
    "CLEANING": ("CLEANING", "HOME CARE"),
    "DAIRY": ("DAIRY",),
    "DELI": ("DELI",),
    "MEAT": ("MEATS", "POULTRY", "SEAFOOD"),
    "BAKERY": ("BREAD/BAKERY",),
    "FROZEN": ("FROZEN FOODS",),
    "PERSONAL_CARE": ("PERSONAL CARE", "BABY CARE", "BEAUTY"),
    "HOME": ("HOME AND KITCHEN I", "HOME AND KITCHEN II", "HOME APPLIANCES", "HARDWARE"),
    "CLOTHING": ("LINGERIE", "LADIESWEAR"),
}
EARTHQUAKE = "2016-04-16"
ENCODED = ("store_nbr", "family", "city", "state", "cluster")
SALES_LAGS = (1, 2, 3, 7, 14, 21, 28, 56)


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def per_date(df: DataFrame, columns: list[str], build) -> DataFrame:
    """``df`` joined with what ``build`` makes of its distinct (date, columns).  A date has one value of each, so the calendar bounds what
    is broadcast: some thousand rows instead of all."""
    dates = build(df.select("date", *columns).distinct())
    new = [c for c in dates.columns if c not in df.columns or c in columns and c != "date"]
    return df.drop(*[c for c in new if c in df.columns]).join(F.broadcast(dates.select("date", *new)), "date", "left")


def add_calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns(F.col("date").cast("date")))


def add_cyclical_encodings(df: DataFrame) -> DataFrame:
    return df.withColumns(cyclical_columns(*map(F.col, ("dayofweek", "month", "dayofyear", "weekofyear"))))


def add_fourier_features(df: DataFrame, periods=((7, 3), (365, 4))) -> DataFrame:
    return df.withColumns(fourier_columns(F.col("dayofweek"), F.col("dayofyear"), list(periods)))


def add_lag_features(df: DataFrame, target: str = "sales", keys=KEYS, lags=SALES_LAGS) -> DataFrame:
    return t.add_lags(df, target, lags, keys)


def add_same_day_last_year_lag(df: DataFrame, target: str = "sales", keys=KEYS) -> DataFrame:
    """Lags of 364 and 365 rows; they are days only in a panel without gaps (``temporal.densify``)."""
    return t.add_lags(df, target, (364, 365), keys)


def add_rolling_features(df: DataFrame, target: str = "sales", keys=KEYS, windows=(7, 14, 28, 56), across: bool = False) -> DataFrame:
    return t.add_rolling(df, target, windows, keys, across=across)


def add_ewm_features(df: DataFrame, target: str = "sales", keys=KEYS, spans=(7, 14, 28)) -> DataFrame:
    return t.add_ewm(df, target, spans, keys)


def add_promotion_features(df: DataFrame, keys=KEYS) -> DataFrame:
    promo = F.col("onpromotion")
    df = df.withColumn("has_promo", (promo > 0).cast("int")).withColumn("onpromotion_log1p", F.log1p(promo))
    df = t.add_lags(df, "onpromotion", (1, 7, 14), keys, prefix="promo")
    df = df.withColumns({f"promo_rolling_sum_{n}": t.rolling(F.col("has_promo"), "sum", n, keys) for n in (7, 14, 28)})
    return df.withColumns({
        "was_promoted_last_week": F.coalesce(F.col("promo_lag_7") > 0, F.lit(False)).cast("int"),
        "promo_change": promo - F.col("promo_lag_1"),
        "promo_intensity": promo / (F.col("promo_rolling_sum_28") / 28 + 1)})


def holiday_flags(df: DataFrame) -> DataFrame:
    """Before-and-after flags of the two distances; the third pre-holiday flag covers 0 to 3 days."""
    to, since = F.col("days_to_holiday"), F.col("days_since_holiday")
    new = {"is_pre_holiday_1": to == 1, "is_pre_holiday_2": to == 2, "is_pre_holiday_3": to <= 3, "is_post_holiday_1": since == 1, "is_post_holiday_2": since == 2}
    df = df.withColumns({k: v.cast("int") for k, v in new.items()})
    if "holiday_type" in df.columns:
        kinds = {"is_bridge_holiday": "Bridge", "is_transfer_holiday": "Transfer", "is_workday_holiday": "Work"}
        df = df.withColumns({k: mentions(F.col("holiday_type"), v) for k, v in kinds.items()})
    return df


def add_holiday_features(df: DataFrame, cap: int = 30) -> DataFrame:
    """Distances to holidays among the panel's own dates, flags, and kinds of holiday."""
    flags = [c for c in ("is_holiday", "is_national_holiday", "is_regional_holiday", "is_local_holiday") if c in df.columns]
    df = df.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags}) if flags else df
    if "is_holiday" not in df.columns:
        return holiday_flags(df.withColumns({"days_to_holiday": F.lit(cap), "days_since_holiday": F.lit(cap)}))

    def build(_: DataFrame) -> DataFrame:
        dates = df.groupBy("date").agg(F.bool_or("is_holiday").alias("h"))
        return t.event_distances(dates, F.col("h"), cap=cap).drop("h")

    return holiday_flags(per_date(df, [], build))


def oil_features(dates: DataFrame) -> DataFrame:
    """Lags, changes and rolling statistics of the price, per date; windows include the day itself."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    x = F.col("dcoilwtico")
    out = dates.withColumn("dcoilwtico", t.fill_both_ways("dcoilwtico", w))
    out = out.withColumns({f"oil_lag_{k}": F.lag("dcoilwtico", k).over(w) for k in (1, 7, 14, 28)})
    out = out.withColumns({f"oil_change_{k}d": F.try_divide(x, F.lag("dcoilwtico", k).over(w)) - 1 for k in (1, 7, 28)}
                          | {f"oil_rolling_{s}_{n}": f("dcoilwtico").over(w.rowsBetween(1 - n, 0)) for n in (7, 14, 28) for s, f in (("mean", F.avg), ("std", F.stddev_samp))})
    return out.withColumn("oil_deviation_28d", (x - F.col("oil_rolling_mean_28")) / (F.col("oil_rolling_std_28") + 1))


def add_oil_features(df: DataFrame) -> DataFrame:
    return per_date(df, ["dcoilwtico"], oil_features) if "dcoilwtico" in df.columns else df


def add_special_event_features(df: DataFrame, event: str = EARTHQUAKE, name: str = "earthquake") -> DataFrame:
    since, period, recovery = event_columns(F.col("date").cast("date"), event)
    return df.withColumns({f"days_since_{name}": since, f"is_{name}_period": period, f"is_{name}_recovery": recovery})


def add_store_family_features(df: DataFrame) -> DataFrame:
    """Store type as a number (unknown: 3), product group of the family (unknown: OTHER)."""
    groups = {f: g for g, families in FAMILY_GROUPS.items() for f in families}
    return df.withColumns({"store_type_num": lookup(STORE_TYPES, F.col("type"), 3), "family_group": lookup(groups, F.col("family"), "OTHER")})


def add_target_encoding(df: DataFrame, target: str = "sales", columns=ENCODED, smoothing: float = 10.0, before: str = "2017-08-01", global_from_train: bool = False) -> DataFrame:
    """``{column}_target_enc``: mean of ``target`` per category, drawn towards the global mean by ``smoothing`` rows.

    Categories are averaged over rows before ``before``; the global mean is over all rows unless ``global_from_train``.  Null and unseen
    categories get the global mean.  One pass of grouping sets, staged, gives all means; its measured size decides how they are joined.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    x, early = F.col(target), F.col("date") < F.lit(before).cast("date")
    sets = [*[[F.col(c)] for c in columns], []]
    which = F.coalesce(*[F.when(F.grouping(c) == 0, c) for c in columns])
    sums = df.select(*dict.fromkeys(columns), x.alias("__x"), early.alias("__early")).groupingSets(sets, *map(F.col, columns)).agg(
        which.alias("__of"), F.sum(F.when(F.col("__early"), F.col("__x"))).alias("__sum"), F.count(F.when(F.col("__early"), F.col("__x"))).alias("__n"),
        F.avg(F.when(F.col("__early") | F.lit(not global_from_train), F.col("__x"))).alias("__mean"))
    codes = stage(sums, "target-means")
    mean = codes.where("__of is null").select("__mean").scalar()
    for c in columns:
        own = codes.where((F.col("__of") == c) & F.col(c).isNotNull() & (F.col("__n") > 0))
        own = own.select(c, ((F.col("__sum") + F.coalesce(mean, F.lit(0.0)) * smoothing) / (F.col("__n") + F.lit(smoothing))).alias("__code"))
        df = df.join(own, c, "left").withColumn(f"{c}_target_enc", F.coalesce("__code", mean)).drop("__code")
    return df


def add_store_family_aggregates(df: DataFrame, target: str = "sales") -> DataFrame:
    """Totals of the store and of the family on the date, 1 and 7 rows before.

    Both come from one pass of grouping sets, staged, so that their measured size decides how they are joined.
    """
    levels = (("store_nbr", "store"), ("family", "family"))
    sets = [[F.col("date"), F.col(key)] for key, _ in levels]
    totals = df.select("date", "store_nbr", "family", F.col(target).alias("__x")).groupingSets(sets, F.col("date"), F.col("store_nbr"), F.col("family"))
    totals = stage(totals.agg(F.grouping("family").alias("__of_store"), F.sum("__x").alias("__total")), "daily-totals")
    for (key, name), of_store in zip(levels, (1, 0), strict=True):
        w = t.series([key])
        daily = totals.where(F.col("__of_store") == of_store).select("date", key, *[F.lag("__total", k).over(w).alias(f"{name}_daily_total_lag{k}") for k in (1, 7)])
        df = df.join(daily, ["date", key], "left")
    return df


def add_zero_inflation_features(df: DataFrame, target: str = "sales", keys=KEYS) -> DataFrame:
    """Zero flags of earlier rows (1 where there is none), shares of zeros, and the running count of zero rows before."""
    df = df.withColumn("is_zero", (F.col(target) == 0).cast("int"))
    w = t.series(keys)
    df = df.withColumns({f"was_zero_lag{k}": F.coalesce(F.lag("is_zero", k).over(w), F.lit(1)) for k in (1, 7)}
                        | {f"zero_ratio_{n}d": t.rolling(F.col("is_zero"), "mean", n, keys) for n in (7, 28)})
    return df.withColumn("days_since_nonzero", t.cumulative(F.col("was_zero_lag1"), keys))


def add_new_series_features(df: DataFrame, target: str = "sales", keys=KEYS) -> DataFrame:
    return t.add_first_positive_age(df, target, keys)


def prepare_train_val_split(df: DataFrame, val_start: str = "2017-08-01", val_end: str = "2017-08-15") -> tuple[DataFrame, DataFrame]:
    d = F.col("date")
    return df.where(d < F.lit(val_start).cast("date")), df.where(d.between(F.lit(val_start).cast("date"), F.lit(val_end).cast("date")))


# Which columns are no features, and what names a feature's groups.
NO_FEATURES = ("id", "date", "sales", "family", "city", "state", "type", "holiday_type", "holiday_description", "is_zero", "family_group")
GROUP_WORDS = {
    "calendar": ("year", "month", "day", "week", "quarter", "payday", "weekend"),
    "cyclical": ("_sin", "_cos"),
    "fourier": ("fourier",),
    "lag": ("_lag_",),
    "rolling": ("rolling",),
    "ewm": ("_ewm_",),
    "promotion": ("promo",),
    "holiday": ("holiday",),
    "oil": ("oil",),
    "store_family": ("store", "cluster", "type_num", "target_enc", "daily_total"),
    "zero_inflation": ("zero", "nonzero", "first_sale", "new_series"),
    "special": ("earthquake",),
}


def get_feature_groups(df: DataFrame) -> dict[str, list[str]]:
    """Features by group: a feature is in every group one of whose words its name holds, so groups overlap."""
    features = [c for c in df.columns if c not in NO_FEATURES]
    any_case = ("promotion", "holiday", "oil")
    return {g: [c for c in features if any(w in (c.lower() if g in any_case else c) for w in words)] for g, words in GROUP_WORDS.items()}


def get_feature_columns(df: DataFrame) -> list[str]:
    """Columns a model may use."""
    return [c for c in df.columns if c not in (*NO_FEATURES, "log_sales")]


def get_categorical_columns(df: DataFrame) -> list[str]:
    return [c for c in ("store_nbr", "cluster") if c in df.columns]


def bool_to_int(df: DataFrame) -> DataFrame:
    flags = {c: F.col(c).cast("int") for c, kind in df.dtypes if kind == "boolean"}
    return df.withColumns(flags) if flags else df


def create_all_features(df: DataFrame, event: str = EARTHQUAKE, encode_before: str = "2017-08-01") -> DataFrame:
    """All families, in one lazy plan over the staged panel, which the features of dates and of totals read too."""
    df = stage(df, "panel")
    for step in (add_calendar_features, add_cyclical_encodings, add_fourier_features, add_lag_features, add_same_day_last_year_lag, add_rolling_features, add_ewm_features,
                 add_promotion_features, add_zero_inflation_features, add_new_series_features, add_holiday_features, add_oil_features):
        df = step(df)
    df = add_store_family_features(add_special_event_features(df, event))
    return add_store_family_aggregates(add_target_encoding(df, before=encode_before))
