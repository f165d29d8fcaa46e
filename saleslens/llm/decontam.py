"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lower-case tokens (runs of letters and digits), tokens 64-bit hashes.  At every position fixed masks
select some tokens and ignore the others; the selected hashes are hashed to one seed.  Test seeds are joined with
training seeds; each hit lays a test item along the document, and the aligned tokens are compared: a window of ``WINDOW``
tokens with at least ``MIN_SIMILARITY`` of them equal is contamination.  Items shorter than the window are compared whole, down to
those of ``min_tokens`` (default: all).

``MASKS`` are complete: a window of the length given with as many substitutions as ``MIN_SIMILARITY`` allows holds a hit of one of its masks
wherever the substitutions are, which ``complete`` enumerates; other parameters for which they aren't are refused.  Documents are
hashed with the masks of the lengths that the benchmark has.

The training side is one pipelined pass over the documents: positions are generated, hashed and probed without being
shuffled.  The test side is broadcast only while its counted seeds are within ``BROADCAST_SEEDS``; beyond that the same
join runs as a shuffle join.

Defined cases: null or empty texts have no tokens and never match; items with equal tokens are compared once and reported each; repeated
documents are judged separately and give one row per id and item; null ids are kept as null.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks by the least item length they are for: positions that a seed looks at, the others may differ.
MASKS = {13: ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8)), 10: ((0, 1, 2, 3), (0, 1, 2, 4)), 8: ((0, 1, 2, 4),), 6: ((0, 1, 3),), 5: ((0, 1, 2), (0, 1, 3)),
         4: ((0, 1, 2, 3),), 3: ((0, 1, 2),), 2: ((0, 1),), 1: ((0,),)}
WINDOW = 13
MIN_SIMILARITY = 0.8
BROADCAST_SEEDS = 1_000_000


def substitutions(n: int, min_similarity: float) -> int:
    """That a window of ``n`` tokens may have."""
    return max(k for k in range(n + 1) if (n - k) / n >= min_similarity)


def complete(masks: tuple[tuple[int, ...], ...], n: int, k: int) -> bool:
    """Whether one of the masks fits somewhere in ``n`` tokens whichever ``k`` of them differ."""
    places = [{o + x for x in m} for m in masks for o in range(n - max(m))]
    return all(any(not p.intersection(gone) for p in places) for gone in combinations(range(n), k))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _class(n: Column) -> Column:
    """Key of ``MASKS`` for items of ``n`` tokens."""
    out = F.lit(None).cast("int")
    for least in sorted(MASKS):
        out = F.when(n >= least, least).otherwise(out)
    return out


def _seeds(rows: DataFrame, classes: list[int], *keep: str, of_items: bool = False) -> DataFrame:
    """A row per position ``i`` of ``wh`` and mask of the ``classes``, with the seed ``h``; of items, masks of their own class."""
    masks = sorted({m for c in classes for m in MASKS[c]})
    at = rows.where(F.size("wh") > 0).select(*keep, "wh", F.explode(F.sequence(F.lit(0), F.size("wh") - 1)).alias("i"))

    def seed(k: int, m: tuple[int, ...]) -> Column:
        fits = F.col("i") + max(m) < F.size("wh")
        if of_items:
            fits = fits & _class(F.size("wh")).isin([c for c in classes if m in MASKS[c]])
        return F.when(fits, F.xxhash64(F.lit(k), *[F.get("wh", F.col("i") + o) for o in m]))

    return at.select(*keep, "wh", "i", F.explode(F.array(*[seed(k, m) for k, m in enumerate(masks)])).alias("h")).where("h is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, min_similarity: float = MIN_SIMILARITY, min_tokens: int = 1) -> DataFrame:
    """(id, item, similarity, first_token): every document and test item that share a window of ``window`` tokens, the best
    share of equal tokens in such a window, and the first token of the document that the item was laid along."""
    for n in range(1, window + 1):
        if not complete(MASKS[max(c for c in MASKS if c <= n)], n, substitutions(n, min_similarity)):
            raise ValueError(f"MASKS are not complete for {n} tokens and similarity {min_similarity}")
    named = benchmark.select(F.col(f"`{item_col}`").alias("item"), token_hashes(F.col(f"`{item_text}`")).alias("wh")).where(F.size("wh") >= max(1, min_tokens))
    named = named.withColumn("k", F.xxhash64("wh"))
    items = named.groupBy("k").agg(F.min("wh").alias("wh"))
    classes = sorted(r[0] for r in items.select(_class(F.size("wh"))).distinct().collect())  # of the keys of MASKS
    seeds = _seeds(items, classes, "k", of_items=True).select("h", "k", F.col("i").alias("j"), F.size("wh").alias("n")).distinct()
    few = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    held = F.broadcast if few else (lambda df: df)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), token_hashes(F.col(f"`{text}`")).alias("wh"))
    if few:
        hits = _seeds(rows, classes, "id").join(held(seeds), "h")
    else:  # the words don't travel with every position: hits come back to their document by its own hash
        rows = rows.withColumn("row", F.xxhash64("id", "wh"))
        found = _seeds(rows, classes, "row").select("row", "i", "h").join(seeds, "h").select("row", "i", "j", "k", "n").distinct()
        hits = found.join(rows.dropDuplicates(["row"]), "row")
    along = F.col("i") - F.col("j")
    cut = hits.select("id", "k", "n", along.alias("d"), F.slice("wh", F.greatest(along, F.lit(0)) + 1, F.col("n") + F.least(along, F.lit(0))).alias("part"))
    once = cut.groupBy("id", "k", "n", "d", "part").count()

    skip = F.greatest(-F.col("d"), F.lit(0))
    w = F.least(F.lit(window), F.col("n"))
    equal = F.zip_with("part", F.slice("wh", skip + 1, F.size("part")), lambda x, y: F.when(x == y, 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("equal") - w), lambda s: F.aggregate(F.slice("equal", s + 1, w), F.lit(0), lambda a, x: a + x)))
    like = (once.join(held(items), "k").withColumn("equal", equal).where(F.size("equal") >= w)
            .withColumn("similarity", best / w).where(F.col("similarity") >= min_similarity)
            .groupBy("id", "k").agg(F.max("similarity").alias("similarity"), F.min(F.greatest("d", F.lit(0))).alias("first_token")))
    return (like.join(held(named.select("k", "item")), "k").groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col))
            .agg(F.max("similarity").alias("similarity"), F.min("first_token").alias("first_token")))
