"""Typed scans of raw, processed and forecast files.  Paths are parameters and go to Spark as they are.

The original data set is not downloaded: put its CSV files into one folder and pass that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.temporal import fill_both_ways
from . import schemas


@dataclass(frozen=True)
class Project:
    """Where a project keeps its files."""

    root: str

    def data_dir(self, sub: str = "raw") -> str:
        return f"{self.root}/data/{sub}"

    @property
    def plots_dir(self) -> str:
        return f"{self.root}/plots"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at ``path``, whatever the file system."""
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or str(e)):
            return False
        raise


def check_data_files(spark: SparkSession, data_dir: str) -> dict[str, bool]:
    """Which of the expected raw files are there."""
    return {name: path_exists(spark, f"{data_dir}/{name}") for name in schemas.RAW_FILES}


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def load_train_data(spark: SparkSession, data_dir: str) -> DataFrame:
    return _csv(spark, f"{data_dir}/train.csv", schemas.SALES)


def load_stores_data(spark: SparkSession, data_dir: str) -> DataFrame:
    return _csv(spark, f"{data_dir}/stores.csv", schemas.STORES)


def load_oil_data(spark: SparkSession, data_dir: str) -> DataFrame:
    """Prices by date, gaps filled forward, then backward.  One row per date: the window is one task of some thousand rows."""
    return _csv(spark, f"{data_dir}/oil.csv", schemas.OIL).withColumn("dcoilwtico", fill_both_ways("dcoilwtico", Window.partitionBy(F.lit(1)).orderBy("date")))


def load_holidays_data(spark: SparkSession, data_dir: str) -> DataFrame:
    return _csv(spark, f"{data_dir}/holidays_events.csv", schemas.HOLIDAYS)


def load_transactions_data(spark: SparkSession, data_dir: str) -> DataFrame | None:
    """Optional source; ``None`` if there is no such file."""
    path = f"{data_dir}/transactions.csv"
    return _csv(spark, path, schemas.TRANSACTIONS) if path_exists(spark, path) else None


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``FileNotFoundError`` if there is nothing at ``path``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no table at {path}; run the step that writes it") from e


def load_master_dataframe(spark: SparkSession, processed_dir: str) -> DataFrame:
    return load_parquet(spark, f"{processed_dir}/train_merged.parquet")


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def load_reconciled_forecasts(spark: SparkSession, predictions_dir: str) -> DataFrame | None:
    return _optional(spark, f"{predictions_dir}/reconciled_forecasts.parquet")


def load_quantile_predictions(spark: SparkSession, predictions_dir: str) -> DataFrame | None:
    return _optional(spark, f"{predictions_dir}/quantile_predictions.parquet")


def load_evaluation_results(spark: SparkSession, predictions_dir: str) -> DataFrame | None:
    return _optional(spark, f"{predictions_dir}/hierarchical_evaluation.csv")


def load_error_by_family(spark: SparkSession, predictions_dir: str) -> DataFrame | None:
    return _optional(spark, f"{predictions_dir}/error_by_family.csv")


def load_historical_data(spark: SparkSession, processed_dir: str, since: str = "2017-06-01") -> DataFrame | None:
    """The master panel from ``since`` on; the filter reaches the Parquet scan."""
    got = _optional(spark, f"{processed_dir}/train_merged.parquet")
    return None if got is None else got.where(F.col("date") >= F.lit(since).cast("date"))
