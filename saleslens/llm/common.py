"""Helpers shared by the corpus operators: word splitting, staged tables, argument checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import discard, new_path
from ..sources.staging import stage as materialize

__all__ = ["GAP", "WORD", "discard", "drop_clashing", "materialize", "n_words", "new_path", "read"]

#: Words are runs of characters other than space, tab, LF, VT, FF and CR.  ``bytes.split()`` without
#: arguments splits UTF-8 bytes at exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same separators for ``split``.
GAP = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words in a text as ``long``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash (in any case) with what an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
