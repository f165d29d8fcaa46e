"""Incremental panel queries.  They go beyond the batch operators: late rows are bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_sales_stream(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    """New Parquet files of ``path`` as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def daily_totals_stream(rows: DataFrame, time: str = "ts", value: str = "value", by=(), delay: str = "1 day") -> DataFrame:
    """Totals per day and ``by``, final once the watermark has passed the day."""
    timed = rows.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", delay)
    out = timed.groupBy(F.window("__time", "1 day").alias("w"), *by).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("date").alias("date"), *by, "total", "n")


def zero_streak_stream(rows: DataFrame, key: str = "series_id", order: str = "date", value: str = "sales") -> DataFrame:
    """(key, date, zero_streak): consecutive zero rows per series, carried over batches.

    Rows of a series must arrive in order of ``order`` across batches; within a batch they are sorted.
    """

    def advance(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for pdf in [pd.concat(list(parts)).sort_values(order)]:
            out = []
            for x in pdf[value]:
                streak = streak + 1 if x == 0 else 0
                out.append(streak)
            yield pd.DataFrame({key: keys[0], order: pdf[order].to_numpy(), "zero_streak": out})
        state.update((streak,))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, {order} date, zero_streak long", "streak long", "append", GroupStateTimeout.NoTimeout)
