"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in code-point order with null last, get the weights of a repeating list and share the budget (by default all words);
a target stops at ``max_epochs`` times its source's size and the excess is reshared by weight.  A source then gives complete
epochs, and the rest by its documents in the order of exponential keys -ln(u) / quality (u from a hash of the id, so reruns
agree), prefix-summed up to the budget; a document is in if the budget lies past its middle.

No source is sorted in one task: keys fall into buckets by their logarithm, ``STEPS`` to a factor of e, so whatever the qualities are a
bucket holds at most 0.4 / ``STEPS`` of the documents of one quality; bucket sums (combined before the shuffle) locate the one bucket per source in
which the budget ends, and only its documents are ordered.  Sources are named by the weights' list: their table, a row each, is one task's.

Defined cases: null or empty texts have size 0 and are taken 0 times; an empty table gives an empty result; repeated ids are
separate rows, ordered by size on equal keys; a null, zero or negative quality counts as ``MIN_QUALITY``; columns named like the outputs are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, n_words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
STEPS = 1024
MIN_QUALITY = 1e-3
#: A table of sources is broadcast up to this many.
BROADCAST_SOURCES = 100_000


def exponential_key(id_col: Column, quality: Column, seed: int = 0) -> Column:
    """-ln(u) / quality with u in (0, 1) from the MD5 of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(MIN_QUALITY))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of the rows (source, source_size), one per source.

    Resharing until none is above its cap ends at min(cap, weight * level): in order of cap / weight, a prefix is capped and
    the level follows from what is left.  The windows run over one row per source.
    """
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("total", F.sum("source_size").over(everything) * share)
    ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    # The level counts where it is at or below the ratio of the first source that isn't capped.
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))).over(everything)["level"]
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(ratio)).withColumn("fits", fits)
    return rows.select("source", "source_size", F.when(F.col("fits").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("fits"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, size: Column | None = None,
        weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """``df`` with size, source_size, target (its source's) and taken (words the mix takes of it, repeats counted).  ``size`` replaces
    the number of words of ``text``.  ``df`` is read twice, so it should be narrow and staged; ``mix_texts`` sees to that."""
    outs = ("size", "source_size", "target", "taken")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outs]
    key = exponential_key(F.col(f"`{id_col}`"), F.lit(1.0) if quality is None else quality, seed)
    rows = df.select(*kept, (n_words(F.col(f"`{text}`")) if size is None else size.cast("long")).alias("size"), F.col(f"`{source}`").alias("__source"), key.alias("__key"))
    rows = rows.withColumn("__bucket", F.floor(F.ln("__key") * STEPS).cast("int"))

    sums = materialize(rows.groupBy(F.col("__source").alias("source"), F.col("__bucket").alias("bucket")).agg(F.sum("size").alias("size")), "mix-buckets")
    plan = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("epochs", F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))), F.lit(max_epochs)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    ends = (sums.withColumn("upto", upto).alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
            .where(F.col("upto") > F.col("rest")).groupBy(F.col("p.source").alias("source"))
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"))).alias("end")))
    plan = materialize(plan.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
                       .select(F.col("p.source").alias("__s"), "source_size", "target", F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.col("end.bucket").alias("__end"), F.col("end.before").alias("__before")), "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("__s")))

    whole = rows.where("__end is null or __bucket != __end").withColumn("__in", F.col("__end").isNull() | (F.col("__bucket") < F.col("__end")))
    order = Window.partitionBy("__source").orderBy("__key", f"`{id_col}`", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("__before") + F.sum("size").over(order) - F.col("size") / 2
    last = rows.where("__bucket = __end").withColumn("__in", middle <= F.col("__rest"))
    return whole.unionByName(last).select(*kept, "size", "source_size", "target", (F.col("size") * (F.col("__epochs") + F.col("__in").cast("long"))).alias("taken"))


def mix_texts(df: DataFrame, qualities: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """``df`` with what ``mix`` adds, sampled by ``qualities`` (id_col, quality; one row per id, others count as 1).

    Rows are decided on by id, hash of the text, source and size in a narrow staged table; texts are read once for their sizes and joined once to
    the decisions.  Rows equal in all of these share the words that are taken of them.
    """
    outs = ("size", "source_size", "target", "taken")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outs]
    row = [F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__text"), F.col(f"`{source}`").alias("__from")]
    sizes = materialize(df.select(*row, n_words(F.col(f"`{text}`")).alias("__size")), "mix-rows")
    rated = qualities.select(F.col(f"`{id_col}`").alias("__rated"), F.col("quality").alias("__quality"))
    narrow = materialize(sizes.join(rated, F.col("__id") == F.col("__rated"), "left").drop("__rated"), "mix-rated")
    discard(sizes)
    mixed = mix(narrow, "__id", "__text", "__from", F.coalesce("__quality", F.lit(1.0)), F.col("__size"), **settings)
    names = ("__id", "__text", "__from")
    taken = mixed.groupBy(*names).agg(*[F.first(c).alias(c) for c in outs[:3]], F.avg("taken").cast("long").alias("taken"))
    taken = materialize(taken.select(*[F.col(c).alias(f"__t{c}") for c in names], *outs), "mix-taken")
    same = [c.eqNullSafe(F.col(f"__t{n}")) for c, n in zip((F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text}`")), F.col(f"`{source}`")), names, strict=True)]
    return df.select(*kept).join(taken, same[0] & same[1] & same[2]).select(*kept, *outs)
