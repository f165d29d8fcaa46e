"""Seeded synthetic raw tables with the shape of the real ones, made by Spark in parallel."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .writers import write_csv

# Names and factors of the generated data.
CITIES = ("Quito", "Guayaquil", "Cuenca", "Machala", "Santo Domingo")
STATES = ("Pichincha", "Guayas", "Azuay", "El Oro", "Santo Domingo")
FAMILIES = ("GROCERY I", "BEVERAGES", "PRODUCE", "CLEANING", "DAIRY", "BREAD/BAKERY", "POULTRY", "MEATS", "PERSONAL CARE", "AUTOMOTIVE")
SCALE = {"GROCERY I": 2.0, "BEVERAGES": 1.5, "PRODUCE": 1.3}
START = "2013-01-01"


def generate_synthetic_data(spark: SparkSession, n_days: int = 365, n_stores: int = 10, n_families: int = 10, seed: int = 42, save_to: str | None = None) -> dict[str, DataFrame]:
    """train, stores, oil and holidays_events.

    Sales: exponential with mean 50, x 1.3 on weekends, x (1 + 0.2 sin(2 pi month / 12)), x the family's scale, x 1.4 if promoted
    (15 %); a tenth is zero.  Oil is a random walk clamped to 30-150, which is sequential and so drawn on the driver, one number per day.
    Every 30th day is a holiday, at most 12.
    """
    rng = random.Random(seed)
    families = FAMILIES[:n_families]
    first = F.lit(START).cast("date")
    n = len(families)
    rows = spark.range(n_days * n_stores * n).withColumn("date", F.date_add(first, F.floor(F.col("id") / (n_stores * n)).cast("int")))
    rows = rows.withColumn("store_nbr", (F.floor(F.col("id") / n) % n_stores + 1).cast("int")).withColumn("family", F.element_at(F.array(*map(F.lit, families)), (F.col("id") % n + 1).cast("int")))
    rows = rows.withColumn("onpromotion", (F.rand(seed) < 0.15).cast("int"))
    base = -50 * F.log1p(-F.rand(seed + 1))
    scale = F.coalesce(F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv])[F.col("family")], F.lit(1.0))
    season = 1 + 0.2 * F.sin(F.lit(2 * math.pi) * F.month("date") / 12)
    sales = base * F.when(F.weekday("date") >= 5, 1.3).otherwise(1.0) * season * scale * F.when(F.col("onpromotion") == 1, 1.4).otherwise(1.0)
    train = rows.withColumn("sales", F.round(F.when(F.rand(seed + 2) < 0.1, 0.0).otherwise(sales), 2)).select(
        F.col("id").cast("int").alias("id"), "date", "store_nbr", "family", "sales", "onpromotion")

    stores = spark.createDataFrame([(i, rng.choice(CITIES), rng.choice(STATES), rng.choice("ABCDE"), rng.randint(1, 17)) for i in range(1, n_stores + 1)], schemas.STORES)
    prices = [80.0]
    while len(prices) < n_days:
        prices.append(min(150.0, max(30.0, prices[-1] + rng.gauss(0, 2))))
    oil = spark.createDataFrame(list(enumerate(prices)), "i int, dcoilwtico double").select(F.date_add(first, F.col("i")).alias("date"), "dcoilwtico")
    events = [(30 * i, rng.choice(("Holiday", "Event", "Transfer")), rng.choice(("National", "Regional", "Local")), "Ecuador", f"Holiday {i}", False) for i in range(min(12, -(-n_days // 30)))]
    holidays = spark.createDataFrame(events, "i int, type string, locale string, locale_name string, description string, transferred boolean").select(F.date_add(first, F.col("i")).alias("date"), "type", "locale", "locale_name", "description", "transferred")
    out = {"train": train, "stores": stores, "oil": oil, "holidays_events": holidays}
    if save_to:
        for name, df in out.items():
            write_csv(df, f"{save_to}/{name}.csv")
    return out
