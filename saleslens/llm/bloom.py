"""A blocked Bloom filter in DataFrame functions: a 512-bit block per key, one bit in each of its eight words.

It lets possible members through to an exact join and decides all other rows without a shuffle.  It has at most ``MAX_BLOCKS`` blocks (8 MB), so it can be
broadcast however many keys there are: more keys only let more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
MAX_BLOCKS = 1 << 17
#: Keys per 512-bit block that the filter is sized for.
PER_BLOCK = 32


def _bits(key: Column) -> list[Column]:
    g = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(WORDS)]


def build_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(block, w0..w7) of a table's keys, and the number of blocks."""
    n = keys.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // PER_BLOCK)))
    rows = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def flagged(rows: DataFrame, key: str, table: DataFrame, blocks: int, flag: str = "__maybe") -> DataFrame:
    """``rows`` with whether the key may be in the filter; a null key is not."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    passed = F.col("__in_block").isNotNull()
    for i, b in enumerate(_bits(F.col(key))):
        passed = passed & (F.col(f"__in_w{i}").bitwiseAND(b) == b)
    at = F.pmod(F.xxhash64(key), F.lit(blocks))
    found = rows.join(F.broadcast(table.select(*[F.col(c).alias(f"__in_{c}") for c in table.columns])), F.col(key).isNotNull() & (at == F.col("__in_block")), "left")
    return found.select(*kept, F.coalesce(passed, F.lit(False)).alias(flag))
