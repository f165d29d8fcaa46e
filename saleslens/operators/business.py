"""Dashboard queries: indicators, drill-down, promotion what-if, inventory cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .features import lookup

# Promotion lift factors by family; others take the average.
ELASTICITY = {
    "SCHOOL AND OFFICE SUPPLIES": 43.57,
    "BABY CARE": 15.15,
    "MAGAZINES": 13.45,
    "BOOKS": 10.98,
    "LADIESWEAR": 8.36,
    "LINGERIE": 7.99,
    "HOME APPLIANCES": 7.23,
    "LAWN AND GARDEN": 6.88,
    "PLAYERS AND ELECTRONICS": 6.22,
    "HARDWARE": 5.49,
}
AVERAGE_ELASTICITY = 6.18


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    for bound, above in ((start, True), (end, False)):
        if bound is not None:
            d = F.lit(bound).cast("date")
            df = df.where(F.col("date") >= d if above else F.col("date") <= d)
    return df


def overview(reconciled: DataFrame, pred: str = "pred_BottomUp", actual: str = "sales") -> DataFrame:
    """One row: actual and forecast totals, difference in percent, number of bottom series."""
    total, bottom = F.col("level") == "Total", F.col("level") == "Bottom"
    out = reconciled.agg(F.sum(F.when(total, F.col(actual))).alias("total_actual"), F.sum(F.when(total, F.col(pred))).alias("total_forecast"), F.count_distinct(F.when(bottom, F.col("series_id"))).alias("n_bottom"))
    return out.withColumn("delta_pct", F.try_divide(F.col("total_forecast") - F.col("total_actual"), F.col("total_actual")) * 100)


def series_by_level(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("level").agg(F.count_distinct("series_id").alias("n_series"))


def level_rmsle(evaluation: DataFrame, level: str, method: str) -> float | None:
    row = evaluation.where((F.col("level") == level) & (F.col("method") == method)).select("rmsle").first()
    return None if row is None else row[0]


def default_series(series_ids: list[str], wanted: str, exact: bool = False) -> list[str]:
    """Series whose name holds ``wanted`` (so ``Store_1`` finds ``Store_10`` too, unless ``exact``)."""
    return [s for s in series_ids if (s == wanted if exact else wanted in s)]


def drilldown(reconciled: DataFrame, level: str, pred: str = "pred_BottomUp", actual: str = "sales", series: list[str] | None = None) -> DataFrame:
    """Error and error in percent of actual + 1 for one level and up to six series."""
    rows = reconciled.where(F.col("level") == level)
    if series:
        rows = rows.where(F.col("series_id").isin(series[:6]))
    error = F.col(pred) - F.col(actual)
    return rows.withColumn("error", error).withColumn("error_pct", F.bround(error / (F.col(actual) + 1) * 100, 1))


def what_if(forecasts: DataFrame, intensity: float = 0.5, elasticity: dict[str, float] | None = None, default: float = AVERAGE_ELASTICITY) -> DataFrame:
    """Forecast and interval scaled by 1 + (elasticity - 1) x intensity."""
    lift = 1 + (lookup(ELASTICITY if elasticity is None else elasticity, F.col("family"), default) - 1) * F.lit(intensity)
    return forecasts.withColumn("lift", lift).withColumns({"pred_simulated": F.col("pred") * F.col("lift"), "pred_q05_sim": F.col("pred_q05") * F.col("lift"), "pred_q95_sim": F.col("pred_q95") * F.col("lift")})


def what_if_totals(simulated: DataFrame, *by: str) -> DataFrame:
    out = simulated.groupBy(*by).agg(F.sum("pred").alias("baseline"), F.sum("pred_simulated").alias("simulated"))
    return out.withColumn("delta", F.col("simulated") - F.col("baseline")).withColumn("delta_pct", F.coalesce(F.try_divide("delta", "baseline") * 100, F.lit(0.0)))


def totals_by_date(simulated: DataFrame) -> DataFrame:
    return simulated.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("sales", "pred", "pred_simulated", "pred_q05_sim", "pred_q95_sim")])


def inventory_cost(forecasts: DataFrame, safety: float = 1.1, unit_cost: float = 1.0, stockout_penalty: float = 5.0) -> DataFrame:
    """Over- and understock of ordering the upper quantile times ``safety``, and of ordering the forecast."""
    zero = F.lit(0.0)

    def policy(order, end: str) -> dict:
        over, out = F.greatest(order - F.col("sales"), zero), F.greatest(F.col("sales") - order, zero)
        return {f"overstock{end}": over, f"stockout{end}": out, f"total_cost{end}": over * unit_cost + out * stockout_penalty}

    rows = forecasts.withColumns({"order_qty": F.col("pred_q95") * safety, "order_naive": F.col("pred")})
    rows = rows.withColumns(policy(F.col("order_qty"), "") | policy(F.col("order_naive"), "_naive"))
    return rows.withColumns({"overstock_cost": F.col("overstock") * unit_cost, "stockout_cost": F.col("stockout") * stockout_penalty})


def cost_summary(costs: DataFrame) -> DataFrame:
    """One row: costs of both policies, savings, and the interval's coverage."""
    out = costs.agg(F.sum("total_cost").alias("total_cost"), F.sum("total_cost_naive").alias("total_cost_naive"), stats.coverage(F.col("sales"), F.col("pred_q05"), F.col("pred_q95")).alias("coverage_pct"))
    savings = F.col("total_cost_naive") - F.col("total_cost")
    return out.withColumn("savings", savings).withColumn("savings_pct", F.when(F.col("total_cost_naive") > 0, savings / F.col("total_cost_naive") * 100).otherwise(0.0))


def cost_by_date(costs: DataFrame) -> DataFrame:
    return costs.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("overstock_cost", "stockout_cost", "total_cost", "total_cost_naive")])
