"""Connected components by alternating large-star and small-star steps over an edge table.

Every step is a grouped minimum (combined before the shuffle) and an equi-join whose sides are written tables,
so adaptive execution can split the rows of a hub.  Nothing is collected but one answer per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step, after which the staged ``edges`` are deleted; they hold (u, v) pairs, u != v.  Large: each node hands its smallest neighbour to its larger
    neighbours; small: to its smaller ones and itself."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).select("u", "m"), "star-min")
    if large:
        new = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = materialize(new.where("u != v").distinct(), "star")
    discard(edges, least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars around their smallest nodes: every u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has an edge, and the smallest node reachable from it.

    Null ends and loops are ignored; repeated edges count once; an empty edge table gives an empty result.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    now = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = _star(_star(now, large=True), large=False)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
