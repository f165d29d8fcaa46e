"""Removal of passages that an earlier document holds too, by relative Lempel-Ziv parsing against seeded reference blocks.

The reference is every document with a smaller id.  Parsing each document against each block of it would be quadratic, so blocks are keyed
by seeds: every window of ``WINDOW`` words chooses its smallest hashed ``SEED``-gram, consecutive windows that choose the same one are a
run, and a seed's block holds the texts of its runs.  Equal windows have equal seeds, so a document's run needs one block only:

1. Parse (one pass, no text is shuffled): the distinct runs (seed, run hash, id) go to their blocks.
2. A run that an earlier document has as a whole is one factor.  Of all others, those whose block has other runs too are listed.
3. Greedy factors: the listed runs' words go to their blocks, in id order.  A block is an index of all stretches of ``WINDOW`` words or more in
   the runs of smaller ids; from each word of a run the longest indexed stretch is taken as factor, and the parse goes on at the
   first window that crosses the factor's boundary.
4. Each document joins its factors, is parsed again, and factors are merged into spans.

Keys that a share of ``HOT`` of all documents has would meet in one task.  They are found in a sample, which decides on
routing only: hot runs are reduced to their smallest id before the shuffle, and their holders look that id up in a bounded
broadcast table; runs of hot seeds are dealt out by run in step 2, and compared window by window in step 3, each window being a factor.

Equal words are equal 64-bit hashes.  Defined cases: a null text has no words; a text of fewer words than a window loses nothing; a null id is
kept whole and is no reference; rows with the same id don't remove each other's words; every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, SEED = 13, 5
#: Documents in the sample that hot keys are looked for in, and the share of them that makes a key hot.
SAMPLE, HOT = 20_000, 0.01
#: Kinds of what step 2 finds: a run of an earlier document, a listed run, the first holder of a hot run, a document with hot runs.
COPY, LISTED, FIRST, HOLDER = range(4)

_M = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers of the polynomial hashes
_N = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(a.view(np.uint64) * _M) + b.view(np.uint64) * _N).view(np.int64)


def _rolling(wh: np.ndarray, n: int, m: np.uint64) -> np.ndarray:
    """Polynomial hashes of all windows of ``n`` word hashes."""
    out = np.zeros(len(wh) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * m + wh[j:j + len(out)]
    return _mix(out)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def parse(found: list[bytes], window: int = WINDOW, seed: int = SEED):
    """(start, end, seed, run, windows, words): window starts [start, end) of every run, its seed and hash, and the hashes of all windows and
    words; None if there is no window."""
    if len(found) < window:
        return None
    wh = np.frombuffer(b"".join(map(xxhash.xxh64_digest, found)), dtype=">u8").astype(np.uint64)
    with np.errstate(over="ignore"):
        whole, grams = _rolling(wh, window, _M), _rolling(wh, seed, _N)
        width = window - seed + 1
        at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(whole))
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        end = np.r_[start[1:], len(at)]
        run = _mix(whole[start] * _M + whole[end - 1] * _N + (end - start).astype(np.uint64))
    return start, end, grams[at[start]].view(np.int64), run.view(np.int64), whole.view(np.int64), wh


def _columns(batches: list[list], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    """One batch of the chunks of every column."""
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(batches, schema.values(), strict=True)], names=list(schema))


def _hot(docs: DataFrame, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and runs, sorted, that ``HOT`` of the sampled documents have; at most (a document's mean number of keys) / ``HOT`` of them."""
    n = docs.count()
    rows = docs.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)) + 1))

    def keys(batches):
        for batch in batches:
            out = [[], []]
            for text in batch.column(0):
                got = parse(words(text.as_py()), window, seed)
                for kind in (0, 1) if got is not None else ():
                    found = np.unique(got[2 + kind])
                    out[0].append(np.full(len(found), kind, dtype=np.int32))
                    out[1].append(found)
            yield _columns(out, {"kind": pa.int32(), "key": pa.int64()})

    found = rows.select("text").mapInArrow(keys, "kind int, key long").groupBy("kind", "key").count()
    found = found.where(F.col("count") >= max(64.0, HOT * min(n, SAMPLE))).select("kind", "key").collect()
    return tuple(np.sort(np.array([r.key for r in found if r.kind == kind], dtype=np.int64)) for kind in (0, 1))


def _runs(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], window: int, seed: int) -> DataFrame:
    """(key, run, id, many, first): the distinct runs of every document, dealt out by seed, or by seed and run if the seed is hot (many).

    A hot run comes once a task, with its smallest id (first); of each document that has one, a row of kind ``HOLDER`` (run null) comes instead.
    """
    schema = {"key": pa.int64(), "run": pa.int64(), "id": pa.int64(), "many": pa.bool_(), "first": pa.bool_()}
    hot_seeds, hot_runs = hot

    def rows(batches):
        lows: dict[int, tuple[int, int]] = {}
        out = [[] for _ in schema]
        for batch in batches:
            holders = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = parse(words(text.as_py()), window, seed)
                if got is None:
                    continue
                _, at = np.unique(got[3], return_index=True)
                seeds, runs = got[2][at], got[3][at]
                often = np.isin(runs, hot_runs)
                if often.any():
                    holders.append(doc)
                    for s, r in zip(seeds[often].tolist(), runs[often].tolist(), strict=True):
                        if r not in lows or doc < lows[r][1]:
                            lows[r] = (s, doc)
                    seeds, runs = seeds[~often], runs[~often]
                many = np.isin(seeds, hot_seeds)
                none = np.zeros(len(runs), bool)
                for x, y in zip(out, (np.where(many, _both(seeds, runs), seeds), runs, np.full(len(runs), doc), many, none), strict=True):
                    x.append(y)
                if sum(map(len, out[0])) > 1 << 18:
                    yield _columns(out, schema)
                    out = [[] for _ in schema]
            yield _columns(out, schema)
            out = [[] for _ in schema]
            if holders:
                ids = np.unique(np.array(holders, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(_both(ids, ids)), pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(np.zeros(len(ids), bool)), pa.array(np.zeros(len(ids), bool))],
                                                 names=list(schema))
        if lows:
            runs, seeds, ids = np.array(list(lows)), *(np.array(x) for x in zip(*lows.values(), strict=True))
            many = np.isin(seeds, hot_seeds)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(many, _both(seeds, runs), seeds), runs, ids, many, np.ones(len(runs), bool))], names=list(schema))

    return docs.where("id is not null").select("id", "text").mapInArrow(rows, "key long, run long, id long, many boolean, first boolean")


def _judge_blocks(runs: DataFrame) -> DataFrame:
    """(id, run, kind): see the kinds.  Of one run, the first holder is listed if its seed has other runs or is hot.

    Rows come sorted by (key, run, id) and are streamed; of a key only its first run and id are held.
    """
    schema = {"id": pa.int64(), "run": pa.int64(), "kind": pa.int8()}

    def judged(batches):
        key = run = low = lone = None  # of the last row: key, run, the run's smallest id, and the key's first (id, run) while it has one run
        for batch in batches:
            holds = np.asarray(batch.column(1).is_null())
            if holds.any():
                ids = np.asarray(batch.column(2))[holds]
                yield _columns([[ids], [np.zeros(len(ids), np.int64)], [np.full(len(ids), HOLDER, np.int8)]], schema)
                batch = batch.filter(pa.array(~holds))
            s, r, d = (np.asarray(batch.column(i)) for i in range(3))
            many, first = (np.asarray(batch.column(i)) for i in (3, 4))
            if not len(s):
                continue
            new_key = np.r_[s[0] != key if key is not None else True, s[1:] != s[:-1]]
            new_run = new_key | np.r_[r[0] != run if run is not None else True, r[1:] != r[:-1]]
            at = np.arange(len(s))
            of_run = np.maximum.accumulate(np.where(new_run, at, -1))
            smallest = np.where(of_run >= 0, d[of_run], low if low is not None else 0)
            copy = ~new_run & (d > smallest)
            # First holders of runs after a key's first one, and of that one as soon as there is a second.
            later = new_run & ~new_key
            of_key = np.maximum.accumulate(np.where(new_key, at, -1))
            opens = np.unique(of_key[later])
            listed = later | (new_run & many)
            listed[opens[opens >= 0]] = True
            out = [(d[copy], r[copy], COPY), (d[listed], r[listed], LISTED), (d[new_run & first], r[new_run & first], FIRST)]
            if len(opens) and opens[0] < 0 and lone is not None:
                out.append((np.array([lone[0]]), np.array([lone[1]]), LISTED))
                lone = None
            if of_key[-1] >= 0:
                lone = None if of_key[-1] in opens or many[of_key[-1]] else (d[of_key[-1]], r[of_key[-1]])
            key, run, low = s[-1], r[-1], smallest[-1]
            yield _columns([[x[0] for x in out], [x[1] for x in out], [np.full(len(x[0]), x[2], np.int8) for x in out]], schema)

    return runs.repartition("key").sortWithinPartitions("key", F.col("run").asc_nulls_first(), "id").mapInArrow(judged, "id long, run long, kind byte")


def _texts_of_runs(docs: DataFrame, listed: DataFrame, hot_seeds: np.ndarray, window: int, seed: int) -> DataFrame:
    """(key, win, id, run, at, words): the word hashes of every listed run by seed; of a hot seed, each window (hash and place in the run) without words."""
    rows = docs.join(listed.groupBy("id").agg(F.collect_set("run").alias("runs")), "id").select("id", "text", "runs")
    schema = {"key": pa.int64(), "win": pa.int64(), "id": pa.int64(), "run": pa.int64(), "at": pa.int32(), "words": pa.binary()}

    def found(batches):
        for batch in batches:
            out = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                got = parse(words(text.as_py()), window, seed)
                if got is None:
                    continue
                start, end, seeds, run, whole, wh = got
                _, at = np.unique(run, return_index=True)
                raw = wh.tobytes()
                at = at[np.isin(run[at], np.asarray(wanted.values))]
                for i, many in zip(at.tolist(), np.isin(seeds[at], hot_seeds).tolist(), strict=True):
                    a, b, key, name = int(start[i]), int(end[i]), int(seeds[i]), int(run[i])
                    if many:
                        out += [(key, w, doc, name, j, None) for j, w in enumerate(whole[a:b].tolist())]
                    else:
                        out.append((key, 0, doc, name, 0, raw[8 * a:8 * (b - 1 + window)]))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, schema.values(), strict=True)], names=list(schema))

    return rows.mapInArrow(found, "key long, win long, id long, run long, at int, words binary")


def greedy(text: bytes, index: set[bytes], window: int) -> Iterator[tuple[int, int]]:
    """Factors (start, end) of a run's word hashes: from each word on the longest indexed stretch, then from the first window across its end."""
    n, i = len(text) // 8, 0
    while i + window <= n:
        end = i + window
        if text[8 * i:8 * end] not in index:
            i += 1
            continue
        while end < n and text[8 * i:8 * (end + 1)] in index:
            end += 1
        yield i, end
        i = end - window + 1


def _factor_blocks(texts: DataFrame, window: int) -> DataFrame:
    """(id, run, a, b): the factors of the listed runs, in words from the run's first.  Rows of one id don't index each other."""
    schema = {"id": pa.int64(), "run": pa.int64(), "a": pa.int32(), "b": pa.int32()}

    def factored(batches):
        key = doc = None
        index, fresh = set(), []
        for batch in batches:
            out = [[] for _ in schema]
            for k, d, run, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):  # key, id, run, words
                if k != key:
                    key, doc, index, fresh = k, d, set(), []
                elif d != doc:
                    for t in fresh:
                        n = len(t)
                        index.update(t[i:j] for i in range(0, n - 8 * window + 1, 8) for j in range(i + 8 * window, n + 1, 8))
                    doc, fresh = d, []
                if index:
                    for a, b in greedy(text, index, window):
                        for x, y in zip(out, (d, run, a, b), strict=True):
                            x.append(y)
                fresh.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, schema.values(), strict=True)], names=list(schema))

    return texts.select("key", "id", "run", "words").repartition("key").sortWithinPartitions("key", "id").mapInArrow(factored, "id long, run long, a int, b int")


def _factor_windows(wins: DataFrame, window: int) -> DataFrame:
    """(id, run, a, b): the windows of hot seeds that an earlier document has.  Smallest ids are combined before the shuffle; the join is of
    two staged tables, so a window that many documents have is split."""
    low = materialize(wins.groupBy("key", "win").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high"), "rlz-first")
    return wins.join(low, ["key", "win"]).where("id > low").select("id", "run", F.col("at").alias("a"), (F.col("at") + window).alias("b"))


def factors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, n_words, spans, kept): one row per row of ``docs``; ``spans`` are the merged factors (start, end) in words, ``kept`` the other
    words joined by one space."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    known = rows.where("id is not null")
    hot = _hot(known, window, seed)
    judged = materialize(_judge_blocks(_runs(known, hot, window, seed)), "rlz-runs")
    lows = {r.run: r.id for r in judged.where(F.col("kind") == FIRST).groupBy("run").agg(F.min("id").alias("id")).collect()}  # of hot runs only
    hot_runs = np.array(sorted(lows), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((hot_runs, np.array([lows[r] for r in hot_runs.tolist()], dtype=np.int64)))

    texts = _texts_of_runs(known, judged.where(F.col("kind") == LISTED), hot[0], window, seed)
    if len(hot[0]):
        texts = materialize(texts, "rlz-texts")
        found = _factor_blocks(texts.where("words is not null"), window).unionByName(_factor_windows(texts.where("words is null"), window))
    else:
        found = _factor_blocks(texts, window)
    part = F.struct("run", "a", "b")
    pieces = found.select("id", part.alias("f"), F.lit(None).cast("long").alias("run")).unionByName(
        judged.where(F.col("kind").isin(COPY, HOLDER)).select("id", F.lit(None).cast("struct<run:long,a:int,b:int>").alias("f"), F.when(F.col("kind") == COPY, F.col("run")).alias("run")))
    per_doc = pieces.groupBy("id").agg(F.collect_list("run").alias("runs"), F.collect_list("f").alias("factors"))

    def merged(batches):
        often, first = shared.value
        for batch in batches:
            out = []
            for doc, text, runs, parts in zip(*(batch.column(i) for i in range(4)), strict=True):
                split = words(text.as_py())
                got = parse(split, window, seed) if runs.is_valid else None
                spans, kept = [], split
                if got is not None:
                    start, end, _, run, _, _ = got
                    whole = np.isin(run, np.asarray(runs.values))
                    if len(often):
                        at = np.minimum(np.searchsorted(often, run), len(often) - 1)
                        whole |= (often[at] == run) & (first[at] < doc.as_py())
                    step = np.zeros(len(split) + 1, dtype=np.int64)
                    np.add.at(step, start[whole], 1)
                    np.add.at(step, end[whole] - 1 + window, -1)
                    inside: dict[int, list] = {}
                    for f in parts.as_py():
                        inside.setdefault(f["run"], []).append(f)
                    for i in np.flatnonzero(np.isin(run, np.array(list(inside), dtype=np.int64))).tolist():
                        for f in inside[int(run[i])]:
                            step[start[i] + f["a"]] += 1
                            step[start[i] + f["b"]] -= 1
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                    kept = [w for w, g in zip(split, gone, strict=True) if not g]
                out.append((doc.as_py(), len(split), spans, b" ".join(kept).decode("utf-8", "replace")))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_words", "spans", "kept"])

    joined = rows.join(per_doc, "id", "left").select("id", "text", "runs", "factors")
    return joined.mapInArrow(merged, "id long, n_words long, spans array<struct<start:int,end:int>>, kept string").withColumnRenamed("id", id_col)
