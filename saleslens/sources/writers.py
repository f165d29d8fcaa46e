"""Sinks: Parquet, single-file CSV, feature lists, models; and narrowing of column types."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting

RULE = "=" * 60


def write_parquet(df: DataFrame, path: str, partition_by=(), sort_by=(), floats: bool = False) -> None:
    """``floats`` stores doubles as floats; ``sort_by`` orders rows inside each file, for run-length encoding and row-group skipping."""
    if floats:
        df = df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_series_table(df: DataFrame, table: str, keys=("store_nbr", "family"), order: str = "date", buckets: int = 64, path: str | None = None) -> None:
    """A table bucketed by series and sorted by date inside each bucket: windows over a series need no exchange when ``spark.table`` reads it.

    Rows are dealt out like the buckets first, so each is one file.  ``path`` keeps the files outside of the warehouse.
    """
    out = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, order)
    (out.option("path", path) if path else out).saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def feature_list_text(groups: dict[str, list[str]], title: str = "ENGINEERED FEATURES") -> str:
    lines = [title, RULE, ""]
    for name, features in groups.items():
        lines += ["", f"{name.upper()} FEATURES ({len(features)}):", "-" * 40, *[f"  - {f}" for f in sorted(features)]]
    total = sum(map(len, groups.values()))
    return "\n".join([*lines, "", "", f"TOTAL FEATURES: {total} ({len(set().union(*groups.values()))} distinct)", ""])


def save_feature_list(df: DataFrame, path: str) -> None:
    """Text file of the features of ``df`` by group, written by Spark so that any file system will do."""
    from ..operators.features import get_feature_groups

    text = feature_list_text(get_feature_groups(df))
    rows = list(enumerate(text.split("\n")))
    df.sparkSession.createDataFrame(rows, "i int, line string").coalesce(1).sortWithinPartitions("i").select("line").write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_models(models: list[PipelineModel], folder: str, prefix: str = "model") -> list[str]:
    paths = [f"{folder}/{prefix}_fold{i}" for i in range(1, len(models) + 1)]
    for m, p in zip(models, paths, strict=True):
        save_model(m, p)
    return paths


def save_boosted(spark: SparkSession, models: dict[str, boosting.Model], path: str) -> None:
    """Boosted models by name, a JSON line each, written by Spark so that any file system will do."""
    rows = [(json.dumps({"name": n, "model": m.to_json()}),) for n, m in models.items()]
    spark.createDataFrame(rows, "line string").coalesce(1).write.mode("overwrite").text(path)


def load_boosted(spark: SparkSession, path: str) -> dict[str, boosting.Model]:
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    return {x["name"]: boosting.Model.from_json(x["model"]) for x in lines}


_INTEGERS = (("tinyint", 7), ("smallint", 15), ("int", 31))


def narrow_types(df: DataFrame) -> DataFrame:
    """Integers in the narrowest type that holds their range (one aggregate over all), doubles as floats."""
    ints = [c for c, t in df.dtypes if t in ("smallint", "int", "bigint")]
    ends = df.agg(*[f(c).alias(f"{i}{n}") for i, c in enumerate(ints) for n, f in (("a", F.min), ("b", F.max))]).first() if ints else {}
    new = {c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"}
    for i, c in enumerate(ints):
        a, b = ends[f"{i}a"], ends[f"{i}b"]
        if a is not None:
            kind = next((k for k, bits in _INTEGERS if -(1 << bits) <= a and b < 1 << bits), "bigint")
            new[c] = F.col(c).cast(kind)
    return df.withColumns(new) if new else df


def estimated_bytes(df: DataFrame) -> int:
    """Rows times the width of their fixed-size types, and the bytes of the strings: what the rows hold uncompressed."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    fixed = sum(widths.get(t, 8) for _, t in df.dtypes if t != "string")
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    total = F.count("*") * fixed
    for x in text:
        total = total + x
    return int(df.agg(total.alias("n")).first()["n"])
