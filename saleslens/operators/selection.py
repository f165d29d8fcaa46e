"""Exact percentiles of groups of any size, without a group's values in one buffer.

A sketch brackets the rank of each percentile from below and above; one counting pass keeps the distinct values inside the brackets, with their counts,
and only counts the rest; the few values of a bracket are then walked in order up to the rank.  A bracket holds about ``6 / ACCURACY`` of a group's
rows, at least ``ACCURACY``; repeated values are one row of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error of a sketch's ranks: 1 / ``ACCURACY`` of the rows.  Groups of so few rows are one bracket.
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, column: str | Column, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(*by, n, q): count and percentiles of the values of each group, interpolated like ``percentile``; nulls don't count.

    Groups without values are left out (without ``by``: no row), and a null key is a group.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    keys = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("__k0")]
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*keys, x.alias("__x")).where(F.col("__x").isNotNull())
    edge = 3 / accuracy
    ends = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-edge, edge)]
    sketch = rows.groupBy(*names).agg(F.count("*").alias("__n"), F.percentile_approx("__x", ends, accuracy).alias("__e"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    few = F.col("__n") <= accuracy
    brackets = [F.struct(F.when(few, F.col("__min")).otherwise(F.col("__e")[2 * i]).alias("low"), F.when(few, F.col("__max")).otherwise(F.col("__e")[2 * i + 1]).alias("high"),
                         (F.lit(float(s)) * (F.col("__n") - 1)).alias("at"), F.lit(i).alias("i")) for i, s in enumerate(shares)]
    sketch = sketch.select(*[F.col(k).alias(f"{k}s") for k in names], "__n", F.array(*brackets).alias("__b"))
    if not by:
        sketch = F.broadcast(sketch)  # one row
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
    inside = F.exists("__b", lambda b: (F.col("__x") >= b["low"]) & (F.col("__x") <= b["high"]))
    below = [F.count_if(F.col("__x") < F.col("__b")[i]["low"]).alias(f"__l{i}") for i in range(len(shares))]
    met = rows.join(sketch, same).withColumn("__v", F.when(inside, F.col("__x"))).groupBy(*names, "__n", "__b", "__v").agg(F.count("*").alias("__c"), *below)

    each = met.select(*names, "__n", "__v", "__c", F.explode(F.arrays_zip("__b", F.array(*[f"__l{i}" for i in range(len(shares))]).alias("l"))).alias("z"))
    each = each.select(*names, "__n", "z.__b.i", "z.__b.at", F.when((F.col("__v") >= F.col("z.__b.low")) & (F.col("__v") <= F.col("z.__b.high")), F.col("__v")).alias("v"), "__c", F.col("z.l").alias("l"))
    # Values outside of this bracket only matter by how many rows are below it.
    part = each.groupBy(*names, "__n", "i", "at", "v").agg(F.sum("__c").alias("c"), F.sum("l").alias("l"))
    group = Window.partitionBy(*names, "i")
    upto = F.sum("l").over(group) + F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).over(group.orderBy(F.col("v").asc_nulls_first()))
    walked = part.select(*names, "__n", "i", "at", "v", upto.alias("upto")).where("v is not null")
    picked = walked.groupBy(*names, "__n", "i", "at").agg(F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"))
    value = F.when(F.floor("at") == F.ceil("at"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    out = picked.groupBy(*names, "__n").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("q")))).alias("q"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, by, strict=False)], F.col("__n").alias("n"), F.transform("q", lambda s: s["q"]).alias("q"))
