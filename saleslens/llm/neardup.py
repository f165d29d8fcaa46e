"""Near copies by word shingles: SimHash fingerprints and, beyond their reach, MinHash bands bring candidates together; exact Jaccard
similarity links them.

1. A text is the set of 64-bit hashes of its shingles of ``SHINGLE`` words.  ``BANDS`` bands of ``ROWS`` minima each are its
   signature; rows with equal words are one node from here on.  Their SimHash fingerprint comes from the same hashes.
2. Nodes with equal fingerprints, or with fingerprints that the pivot distance tables of ``simhash`` link (at most ``RADIUS`` bits), share a bucket.
   At a similarity of 0.8, fingerprints differ in about 10 of 64 bits, which no table of bit blocks can route, so
   nodes with an equal band share a bucket too.  Two texts of similarity s meet in at least one with probability
   1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8, and more above.  Buckets with the same members count once.
3. Only nodes of buckets of two or more carry their sets along.  A bucket is dealt into pieces of about ``PIECE`` nodes, each with the
   bucket's first node; a piece hands on a spanning forest of the links with Jaccard similarity ``MIN_JACCARD`` or more,
   compared exactly, never all pairs; nothing less similar is linked.
4. In a bucket of several pieces whose nodes aren't one component by then, every node outside the largest one is compared with all nodes of other
   components, in tasks of two pieces; what links components is handed on.  So no link is lost and no task gets more than two pieces.
5. Components of the nodes; of each, the row with the smallest id stays.

Defined cases: texts without words (null, empty) are equal to each other; texts of fewer than ``SHINGLE`` words are one shingle;
letters A-Z count as lower case; repeated rows are one group, of which one row stays; null ids come after all others; columns may have any names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import build_filter, flagged
from .common import GAP, discard, materialize
from .graph import connected_components
from .simhash import fingerprint_links, of_hashes
from .urlfilter import LOWER, UPPER

SHINGLE = 5
MIN_JACCARD = 0.8
BANDS, ROWS = 24, 5
PIECE = 128
RADIUS = 3

_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text (repeated ones repeat)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.array([], dtype=np.uint64)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    k = min(SHINGLE, len(words))
    begin, end = starts[:len(words) - k + 1].tolist(), (starts[k:] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, begin, end)), repeat(42)), dtype=np.uint64, count=len(begin))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key per band; the number of the band enters it.  A text without words has none."""
    if not len(hashes):
        return []
    least, now = np.empty(len(_FACTORS), dtype=np.uint64), np.empty_like(hashes)
    for i, f in enumerate(_FACTORS):
        least[i] = np.multiply(hashes, f, out=now).min()
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _signature(text: Column) -> Column:
    @F.pandas_udf("fp long, bands array<long>")
    def signatures(texts: pd.Series) -> pd.DataFrame:
        every = [shingles(t) for t in texts]
        fps = pd.Series([of_hashes(h) if len(h) else None for h in every], dtype="Int64")
        return pd.DataFrame({"fp": fps, "bands": [bands(h) for h in every]})

    return signatures(text)


def _set(text: Column) -> Column:
    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(t)).tobytes() for t in texts], dtype=object)

    return sets(text)


def _similar(x: int, near: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Those of ``near`` whose sets have Jaccard similarity ``MIN_JACCARD`` or more with set ``x``."""
    near = near[(sizes[near] >= MIN_JACCARD * sizes[x]) & (sizes[x] >= MIN_JACCARD * sizes[near])]
    if not len(near):
        return near
    every = np.concatenate([sets[i] for i in near])
    at = np.minimum(np.searchsorted(sets[x], every), sizes[x] - 1)
    ends = np.cumsum(sizes[near])
    shared = np.diff(np.r_[0, np.r_[0, np.cumsum(sets[x][at] == every)][ends]])
    # Whole numbers where it matters: shared / union >= 0.8.
    return near[shared * 10 >= round(MIN_JACCARD * 10) * (sizes[x] + sizes[near] - shared)]


def _forest(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links of one piece, breadth first; every node is compared with those not reached yet only."""
    links = []
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            found = _similar(x, left, sets, sizes)
            links += [(names[x], names[y]) for y in found.tolist()]
            queue.extend(found.tolist())
            left = left[~np.isin(left, found)]
    return links


def _bridges(parts: list[int], outer: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between components ``parts``: each ``outer`` node against the others of components that nothing here has linked yet."""
    links, sizes, now, far = [], np.array([len(s) for s in sets]), np.array(parts), np.array(outer)
    for x in np.flatnonzero(far):
        rest = np.flatnonzero((now != now[x]) & ~far)
        for y in _similar(int(x), rest, sets, sizes):
            if now[y] != now[x]:
                links.append((parts[x], parts[y]))
                now[now == now[y]] = now[x]
    return links


def _by_key(rows: DataFrame, columns: list[str], found) -> DataFrame:
    """(a, b) pairs that ``found`` makes of the lists of ``columns`` and of the sets of each key ``k``."""

    def links(batches):
        key, held = None, []

        def done():
            *lists, sets = zip(*held, strict=True)
            pairs = found(*map(list, lists), [np.frombuffer(s, dtype=np.uint64) for s in sets])
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, *r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield done()
                    key, held = k, []
                held.append(r)
        if len(held) > 1:
            yield done()

    return rows.select("k", *columns, "set").repartition("k").sortWithinPartitions("k").mapInArrow(links, "a long, b long")


def _pieces(n: Column) -> Column:
    return F.ceil(n / PIECE)


def _of(n: Column, *key: str) -> Column:
    """Which of ``n`` pieces a row is dealt to."""
    return F.pmod(F.xxhash64(*key), n)


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _roots(members: DataFrame, once: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, root) of the nodes that have links: ``once`` holds the buckets (k, n, m: size and first node), ``members`` those of their nodes (k, n, m, g), ``sets`` (g, set)."""
    t = _pieces(F.col("n"))
    dealt = members.where("g != m").select("k", "g", _of(t, "k", "g").alias("i"))
    firsts = once.select("k", F.col("m").alias("g"), _upto(t).alias("i"))
    pieces = materialize(dealt.unionByName(firsts).select(F.xxhash64("k", "i").alias("k"), "g"), "neardup-pieces")
    links = materialize(_by_key(pieces.join(sets, "g"), ["g"], _forest), "neardup-links")
    roots = materialize(connected_components(links).select(F.col("node").alias("g"), "root"), "neardup-roots")
    discard(pieces, links)
    named = members.where(t > 1).join(roots, "g", "left").select("k", "g", "n", F.coalesce("root", "g").alias("c"))
    named = materialize(named, "neardup-named")
    parts = named.groupBy("k", "c").agg(F.count("*").alias("size")).groupBy("k")
    parts = parts.agg(F.max_by("c", F.struct("size", "c")).alias("top"), (F.sum("size") - F.max("size")).alias("rest")).where("rest > 0")
    parts = materialize(parts, "neardup-parts")
    if parts.isEmpty():
        return roots
    both, tr = named.join(parts, "k"), _pieces(F.col("rest"))
    inner = both.select("k", "g", "c", _of(t, "k", "g").alias("i"), _upto(tr).alias("j"), F.lit(False).alias("outer"))
    outer = both.where("c != top").select("k", "g", "c", _upto(t).alias("i"), _of(tr, "g", "k").alias("j"), F.lit(True).alias("outer"))
    pairs = materialize(inner.unionByName(outer).select(F.xxhash64("k", "i", "j").alias("k"), "g", "c", "outer"), "neardup-outer")
    bridges = materialize(_by_key(pairs.join(sets, "g"), ["c", "outer"], _bridges), "neardup-bridges")
    joined = materialize(connected_components(bridges).select(F.col("node").alias("c"), F.col("root").alias("r")), "neardup-joined")
    # Both ends of a bridge may be nodes without a link of their own.
    every = roots.unionByName(joined.select(F.col("c").alias("g"), F.col("c").alias("root"))).distinct()
    out = materialize(every.join(joined, F.col("root") == F.col("c"), "left").select("g", F.coalesce("r", "root").alias("root")).distinct(), "neardup-roots")
    discard(named, parts, pairs, bridges, joined, roots)
    return out


def _words_hash(text: Column) -> Column:
    """Hash of the words of a text in order, A-Z in lower case."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")
    return F.xxhash64(F.array_join(words, " "))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the smallest id (null after all others).

    Texts are read for their signatures and again for what stays; what is staged is narrow.  Bloom filters of the texts of shared buckets, and of what goes (the
    smaller part), let only their texts, and false positives, into the shuffles of the joins that decide, the last one by id and words.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    own_id = F.col(f"`{id_col}`")
    named = df.select(*columns, _words_hash(F.col(f"`{text}`")).alias("__g"))
    rows = materialize(named.select("__g", own_id.alias("id"), _signature(F.col(f"`{text}`")).alias("s")).select(F.col("__g").alias("g"), "id", "s.fp", "s.bands"), "neardup")
    order = F.struct(F.col("id").isNull().alias("no"), "id", "g")
    nodes = materialize(rows.groupBy("g").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "neardup-nodes")
    printed = nodes.where("fp is not null").select("g", "fp")
    near = materialize(fingerprint_links(printed.select("fp"), RADIUS), "neardup-near")
    ends = near.select(F.xxhash64(F.lit("link"), F.least("a", "b"), F.greatest("a", "b")).alias("k"), F.explode(F.array("a", "b")).alias("fp")).distinct()
    keyed = (nodes.select("g", F.explode("bands").alias("k")).unionByName(printed.select("g", F.xxhash64(F.lit("fp"), "fp").alias("k")))
             .unionByName(ends.join(printed, "fp").select("g", "k")))
    buckets = keyed.groupBy("k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("g")).alias("x"), F.min("g").alias("m")).where("n > 1")
    once = materialize(buckets.groupBy("n", "x", "m").agg(F.min("k").alias("k")).select("k", "n", "m"), "neardup-buckets")
    members = materialize(keyed.join(once, "k").select("k", "n", "m", "g"), "neardup-members")
    wanted = materialize(members.select(F.col("g").alias("__wanted")).distinct(), "neardup-wanted")
    maybe = flagged(named.select("__g", F.col(f"`{text}`").alias("t")), "__g", *build_filter(wanted, "__wanted")).where("__maybe")
    texts = maybe.join(wanted, F.col("__g") == F.col("__wanted"), "left_semi").groupBy(F.col("__g").alias("g")).agg(F.first("t").alias("t"))
    sets = materialize(texts.select("g", _set(F.col("t")).alias("set")), "neardup-sets")
    roots = _roots(members, once, sets)
    discard(members, sets, wanted, once, near)
    owned = nodes.select("g", "first").join(roots, "g", "left").withColumn("root", F.coalesce("root", "g"))
    kept = materialize(owned.groupBy("root").agg(F.min("first").alias("f")).select("f.g", "f.id"), "neardup-kept")
    pairs = materialize(rows.groupBy("g", "id").agg(F.count("*").alias("rows")), "neardup-pairs")
    discard(rows, nodes)

    def pair(x: DataFrame, tag: str) -> DataFrame:
        return materialize(x.select(F.col("g").alias("__pg"), F.col("id").alias("__pid")), tag)

    same = pairs["g"].eqNullSafe(kept["g"]) & pairs["id"].eqNullSafe(kept["id"])
    gone = pair(pairs.join(kept, same, "left_anti"), "neardup-gone")
    again = pair(pairs.where("rows > 1").join(kept, same, "left_semi"), "neardup-again")
    match = (F.col("__g") == F.col("__pg")) & own_id.eqNullSafe(F.col("__pid"))
    judged = flagged(named, "__g", *build_filter(gone, "__pg"))
    stays = judged.where("not __maybe").unionByName(judged.where("__maybe").join(gone, match, "left_anti"))
    if again.isEmpty():
        return stays.select(*columns)
    repeats = stays.join(again, match, "left_semi").dropDuplicates(["__g", id_col])
    return stays.join(again, match, "left_anti").select(*columns).unionByName(repeats.select(*columns))
