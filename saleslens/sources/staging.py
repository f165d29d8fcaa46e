"""Intermediate tables in the folder that every executor reaches, ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="saleslens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the folder of this application."""
    return f"{shared_dir(spark)}/saleslens-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors; what reads it next knows the table's real size, so joins are broadcast only if it
    is small, and adaptive execution can split a skewed side.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*staged: DataFrame) -> None:
    """Delete tables, as ``stage`` returned them, that nothing reads any more."""
    for df in staged:
        delete(df.sparkSession, df.staged_path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged; its lazy results can't be read afterwards."""
    delete(spark, f"{shared_dir(spark)}/saleslens-{spark.sparkContext.applicationId}")
