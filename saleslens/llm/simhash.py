"""SimHash near-duplicate detection with pivot distance tables.

1. Fingerprint: XXH64 (seed 42) of every word shingle; a bit is set if it is set in over half the hashes.
2. Pivot table: the Hamming distances of every distinct fingerprint to ``N_PIVOTS`` reference fingerprints, computed
   once.  By the triangle inequality, fingerprints at most r apart differ by at most r in each coordinate.
3. Rows meet in buckets of equal bit blocks (of r + 2 blocks, two fingerprints at most r bits apart share two).
   Pivot coordinates alone can't route: on 64 bits each lets 46 % of random pairs pass.  Within a bucket,
   pairs are discarded by their largest coordinate difference and the survivors verified exactly.
4. A bucket of over ``MAX_BUCKET`` distinct fingerprints is dealt out again by finer blocks, until at most 2**14
   different fingerprints can share one; a bucket hands on a spanning forest of its links, never all pairs.
5. Components of the distinct fingerprints, then of the rows that carry them.

Defined cases: a null or empty text has fingerprint zero and links like any other; rows with equal fingerprints link;
repeated ids are separate rows; a null id is kept and never names a component unless nothing else could (null).
"""

from __future__ import annotations

import hashlib
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

BITS = 64
N_PIVOTS = 16
MAX_BUCKET = 4096
#: Bits left free in the finest buckets, so that none holds over 2**14 different fingerprints.
FREE_BITS = 14


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42, step: int = 1 << 16) -> int:
    """Signed 64-bit SimHash of one whole text; memory is bounded by ``step`` shingles at a time."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    k = min(words_per_shingle, len(words))
    begin, end = starts[:len(words) - k + 1].tolist(), (starts[k:] - 1).tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(begin), step):
        hashes = b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, map(slice, begin[i:i + step], end[i:i + step])), repeat(seed)))
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begin)).view(">i8")[0])


def of_hashes(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """``fingerprint`` of the given shingle hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), step):
        counts += np.unpackbits(hashes[i:i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", words_per_shingle: int = 3) -> DataFrame:
    """``df`` with a ``long`` fingerprint column (an existing column of that name is replaced)."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return df.withColumn(out, fingerprints(F.col(text)))


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Fixed reference fingerprints, spread like random ones."""
    return [int.from_bytes(hashlib.md5(f"pivot {i}".encode()).digest()[:8], "big", signed=True) for i in range(n)]


def with_pivot_distances(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Adds d0, d1, ...: eight distances each, a byte per pivot."""
    refs, cols = pivots(), {}
    for i in range(0, len(refs), 8):
        packed = F.lit(0).cast("long")
        for j, p in enumerate(refs[i:i + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("long"), 8 * j))
        cols[f"d{i // 8}"] = packed
    return fps.withColumns(cols)


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def coarse_masks(radius: int) -> list[int]:
    """Of radius + 2 blocks of bits, two equal ones; any two fingerprints within ``radius`` agree on one of the masks."""
    blocks = _blocks(list(range(BITS)), radius + 2)
    return [_mask(a + b) for a, b in combinations(blocks, 2)]


def fine_masks(coarse: int, radius: int) -> list[int]:
    """Masks that refine ``coarse``: of n blocks of its free bits, n - radius equal ones; at most FREE_BITS stay free."""
    free = [b for b in range(BITS) if not (coarse >> b) & 1]
    n = radius + 1
    while n < len(free) and sum(sorted(map(len, _blocks(free, n)))[-radius:]) > FREE_BITS:
        n += 1
    fixed = [b for b in range(BITS) if (coarse >> b) & 1]
    return [_mask(fixed + sum(x, [])) for x in combinations(_blocks(free, n), n - radius)]


def _forest(fp: np.ndarray, piv: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning forest of one large bucket, breadth first; every node is compared with those not reached yet only."""
    a, b = [], []
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.arange(len(left))
            for c in range(piv.shape[1]):
                near = near[np.abs(piv[left[near], c] - piv[x, c]) <= radius]
                if not len(near):
                    break
            near = near[np.bitwise_count(fp[left[near]] ^ fp[x]) <= radius]
            if len(near):
                found = left[near]
                a.extend(repeat(int(x), len(found)))
                b.extend(found.tolist())
                queue.extend(found.tolist())
                left = np.delete(left, near)
    return a, b


def _linked(key: np.ndarray, fp: np.ndarray, piv: np.ndarray, radius: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links inside complete buckets of sorted keys."""
    edges_a, edges_b = [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    of_small = np.repeat(sizes <= small, sizes)
    for s in range(1, int(sizes[sizes <= small].max(initial=0))):
        i = np.flatnonzero(of_small[:-s] & (key[s:] == key[:-s]))
        if not len(i):
            break
        i = i[(np.abs(piv[i] - piv[i + s]) <= radius).all(axis=1)]
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= radius]
        edges_a.append(fp[i])
        edges_b.append(fp[i + s])
    for at, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        a, b = _forest(fp[at:at + n], piv[at:at + n], radius)
        edges_a.append(fp[at:at + n][a])
        edges_b.append(fp[at:at + n][b])
    none = np.array([], dtype=np.int64)
    return np.concatenate([*edges_a, none]), np.concatenate([*edges_b, none])


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of the rows (k, fp, d0, d1), bucket by bucket; a bucket's size is bounded before."""

    def links(batches):
        held = None
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key = held[0]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield of([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield of(held)

    def of(cols):
        piv = np.stack(cols[2:], axis=1).view(np.uint8).astype(np.int16)
        a, b = _linked(cols[0], cols[1], piv, radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("k", "fp", "d0", "d1").repartition("k").sortWithinPartitions("k").mapInArrow(links, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct fingerprints ``fp`` at most ``radius`` apart."""
    masks = coarse_masks(radius)
    table = with_pivot_distances(fps.select("fp").distinct())

    def keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
        # The mask's number enters the hash, so tables don't mix; a clash of hashes only adds pairs to verify.
        key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
        return rows.withColumn("k", key)

    rows = materialize(keyed(table, masks), "simhash-buckets")
    hot = materialize(rows.groupBy("k").count().where(F.col("count") > MAX_BUCKET).select("k"), "simhash-hot")
    if hot.isEmpty():
        return _bucket_links(rows, radius)
    links = _bucket_links(rows.join(hot, "k", "left_anti"), radius)
    again = rows.join(hot, "k", "left_semi")
    finer = None
    for i, m in enumerate(masks):
        mine = again.where(F.col("k") == F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m)))).drop("k")
        key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.col("fp").bitwiseAND(F.lit(f))) for j, f in enumerate(fine_masks(m, radius))]))
        finer = mine.withColumn("k", key) if finer is None else finer.unionByName(mine.withColumn("k", key))
    return links.unionByName(_bucket_links(finer, radius))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id reachable over links of at most ``radius`` differing bits."""
    docs = materialize(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "fp", words_per_shingle).select("id", "fp"), "simhash")
    first = materialize(docs.groupBy("fp").agg(F.min("id").alias("first")), "simhash-first")
    roots = materialize(connected_components(fingerprint_links(first, radius)), "simhash-roots").select(F.col("node").alias("fp"), "root")
    owned = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = materialize(owned.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    names = materialize(owned.join(least, "root").select("fp", "component_id"), "simhash-names")
    return docs.join(names, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
