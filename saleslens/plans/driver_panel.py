"""The driver's order tables as a demand panel: nations are stores, part types families, quantities sales."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import assemble
from ..operators.temporal import densify
from ..sources.staging import stage

YEARS = range(1995, 2002)
#: (month, day, type, locale, description, transferred); every year has them all.
EVENTS = (
    (1, 1, "Holiday", "National", "New Year", False),
    (4, 10, "Transfer", "Regional", "Province Day", True),
    (5, 1, "Holiday", "National", "Labour Day", False),
    (5, 24, "Work Day", "National", "Make-up day", False),
    (8, 10, "Bridge", "National", "Bridge day", False),
    (12, 25, "Holiday", "National", "Christmas", False),
    (12, 25, "Event", "Local", "Market", False),
)
SPECIAL_EVENT, ENCODE_BEFORE = "1998-04-16", "2001-01-01"


def holiday_rows() -> list[tuple]:
    return [(i, date(y, m, d), kind, place, text, moved) for i, (y, (m, d, kind, place, text, moved)) in enumerate((y, e) for y in YEARS for e in EVENTS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, store_nbr, family, sales, onpromotion) of the dates that have sales."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", F.col("l_shipdate").cast("date").alias("date"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("store_nbr"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("family"))
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("date", "store_nbr", "family").agg(F.sum("l_quantity").alias("sales"), F.count_if(F.col("l_discount") >= 0.05).alias("onpromotion"))


def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``facts``, staged: one pass over the lines serves dates, series and rows."""
    return stage(facts(spark, sf_dir), "facts")


def panel(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """``facts`` for every observed date and series, absent ones 0."""
    return densify(known_facts(spark, sf_dir) if known is None else known, fill={"sales": 0.0, "onpromotion": 0})


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(n.cast("int").alias("store_nbr"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.char(65 + n % 5).alias("type"), (n % 17 + 1).cast("int").alias("cluster"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily price with gaps at weekends: the largest order of the day."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").where(F.weekday(day) < 5).groupBy(day.alias("date")).agg(F.max("o_totalprice").alias("dcoilwtico"))


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(holiday_rows(), "ord int, date date, type string, locale string, description string, transferred boolean")


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_facts(spark, sf_dir)
    return assemble(panel(spark, sf_dir, known), stores(spark, sf_dir), prices(spark, sf_dir), holidays(spark), "ord", dates=known)
