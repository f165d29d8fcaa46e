"""String helpers: series ids, substring flags, labels and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unique_id(store: Column, family: Column) -> Column:
    return F.concat_ws("_", store.cast("string"), family)


def store_of(uid: Column) -> Column:
    return F.split(uid, "_", 2)[0]


def family_of(uid: Column) -> Column:
    """What follows the first underscore; a family may hold underscores itself."""
    return F.split(uid, "_", 2)[1]


def mentions(c: Column, word: str) -> Column:
    """1 if ``word`` occurs in any case; null counts as the text ``None``."""
    return F.lower(F.coalesce(c, F.lit("None"))).contains(word.lower()).cast("int")


def first_seen_list(value: Column, order: Column) -> Column:
    """Aggregate: distinct values in order of first appearance, joined by commas."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.array_distinct(F.transform(pairs, lambda p: p["v"])), ",")


def short_number(n: Column, decimals: int = 0) -> Column:
    """Thousands separators; ``N/A`` for null."""
    return F.coalesce(F.format_number(n, decimals), F.lit("N/A"))


def method_label(pred_col: Column) -> Column:
    return F.initcap(F.replace(F.replace(pred_col, F.lit("pred_"), F.lit("")), F.lit("_"), F.lit(" ")))


def label_codes(values: list[str]) -> dict[str, int]:
    """Codes by code-point order of the string form."""
    return {v: i for i, v in enumerate(sorted({str(x) for x in values}))}
