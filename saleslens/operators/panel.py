"""From raw tables to the master panel: one row per date, store and family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import master_calendar_columns
from ..functions.text import first_seen_list
from .temporal import asof_join, fill_both_ways


def process_holidays(holidays: DataFrame, order: str | None = None) -> DataFrame:
    """One row per date: flags of its events, and their types and descriptions joined in order.

    Any event marks its date for all stores (locale names are not matched).  File order is not kept by a shuffle, so the order
    comes from the column ``order`` if given, else from (type, description).
    """
    at = F.col(order) if order else F.struct("type", "description")
    flag = {"is_national_holiday": "National", "is_regional_holiday": "Regional", "is_local_holiday": "Local"}
    return holidays.groupBy("date").agg(
        first_seen_list(F.col("type"), at).alias("holiday_type"),
        *[F.coalesce(F.bool_or(F.col("locale") == v), F.lit(False)).alias(k) for k, v in flag.items()],
        F.coalesce(F.bool_or(F.coalesce("transferred", F.lit(False))), F.lit(False)).alias("is_transferred"),
        first_seen_list(F.col("description"), at).alias("holiday_description")).withColumn("is_holiday", F.lit(True))


def filled_prices(panel_dates: DataFrame, oil: DataFrame) -> DataFrame:
    """Price of every panel date: that day's, or the last one on a panel date, or the next.  One row per date."""
    spine = panel_dates.select("date").distinct().join(oil.select("date", "dcoilwtico"), "date", "left")
    return spine.withColumn("dcoilwtico", fill_both_ways("dcoilwtico", Window.partitionBy(F.lit(1)).orderBy("date")))


def prices_as_of(panel_dates: DataFrame, oil: DataFrame) -> DataFrame:
    """As ``filled_prices``, but prices of days outside the panel count too (no look-ahead)."""
    return asof_join(panel_dates.select("date").distinct(), oil.where(F.col("dcoilwtico").isNotNull()), "date", values=["dcoilwtico"])


def assemble(sales: DataFrame, stores: DataFrame, oil: DataFrame, holidays: DataFrame, holiday_order: str | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Master panel: sales with stores, prices and holidays of the date, calendar columns.

    The facts are not shuffled for tables of one row per date, which the calendar bounds; stores are a file, whose size Spark knows.
    ``dates`` holds the panel's dates, if they can be had for less than a pass over ``sales``.
    """
    out = sales.join(stores, "store_nbr", "left")
    out = out.join(F.broadcast(filled_prices(sales if dates is None else dates, oil)), "date", "left")
    out = out.join(F.broadcast(process_holidays(holidays, holiday_order)), "date", "left")
    flags = ["is_holiday", "is_national_holiday", "is_regional_holiday", "is_local_holiday", "is_transferred"]
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(c, F.lit("None")) for c in ("holiday_type", "holiday_description")})
    return out.withColumns(master_calendar_columns(F.col("date")))
