"""Approximate nearest neighbours over balanced posting lists.

Centroids are kept in two levels, so that their number grows with the table: cells, fitted on a bounded sample and linked to an in-memory
neighbour graph that is broadcast, and the lists of each cell, fitted and linked in a task of their own on up to ``SAMPLE`` of the cell's
vectors.  Over-full clusters are split until lists are balanced.  Every vector is put into the list of its nearest centroid and, near a
boundary, into those of up to ``REPLICAS`` - 1 others within a ratio of that distance, in whichever cell they are.  A query searches the
graphs for its nearest cells and their nearest lists, keeps those within a ratio of the nearest distance, and scans them exactly in double
precision; numbers and ratios are tuned for a wanted recall by the true neighbours of ``TUNED`` queries in the whole table.  Queries whose lists
hold too few vectors read more lists, and those for which that isn't enough either are answered exactly.

Inner products are searched as distances: a vector x becomes (x, sqrt(M^2 - |x|^2)), M the largest norm, a query (q M / |q|, 0).
Equal vectors are one class in the index (with as many smallest ids as an answer can need), so copies fill no list.  Neighbouring lists
form groups: a vector is sent once to each group that has a list of it, and a group keeps a query's best only; groups and their queries are
dealt out in shards of bounded size.

Defined cases: vectors that are null, zero, of another than the most frequent dimension, or hold null or non-finite components take no part, nor do null
ids; repeated rows of one id and vector count once; rows with the query's own id are never its neighbours; fewer candidates than ``k`` are all
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Vectors that the cells' centroids, and those of the lists of one cell, are fitted on, at most; distinct vectors aimed at per list; cells at most.
SAMPLE, LIST_SIZE, MOST_CELLS = 40_000, 128, 5000
#: Lists of one vector at most, and how much farther than the nearest their centroids may be.
REPLICAS, BOUNDARY = 4, 1.1
#: Centroids that a search of a graph keeps while it assigns vectors; links of a centroid.
BEAM, DEGREE = 32, 24
#: Recall that queries are tuned for, queries that it is tuned on, cells that they look at meanwhile, and lists that any query reads at least.
RECALL, TUNED, WIDE, LEAST_LISTS = 0.96, 256, 64, 4
#: How many times as many lists queries read in turn whose own hold too few vectors, before they are answered exactly.
MORE = (8, 64)
#: Neighbouring lists that are scanned together, and rows of such a group, and queries of it, that meet in one call.
GROUP, SHARD = 64, 16384


def lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1, keepdims=True), 0))])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0)


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i:i + step] @ c.T - half, axis=1) for i in range(0, len(x), step)])


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means; clusters of over twice the mean size are split in two, empty ones dropped."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)]
    for turn in range(rounds):
        own = _nearest(sample, c)
        sizes = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(sample[order], np.r_[0, np.cumsum(sizes[sizes > 0])[:-1]], axis=0)
        c = sums / sizes[sizes > 0][:, None]
        if turn < rounds - 2:
            large = np.flatnonzero(sizes[sizes > 0] > 2 * len(sample) / n_lists)
            spread = sample.std(axis=0) * 0.05
            c = np.vstack([c, c[large] + rng.normal(size=(len(large), sample.shape[1])) * spread])
    return c


def link_centroids(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbour lists (n, degree): two thirds nearest, the rest from a ring of growing strides, which keeps the graph connected."""
    n = len(c)
    near = max(1, min(degree * 2 // 3, n - 1))
    out = np.empty((n, near), dtype=np.int32)
    for i in range(0, n, 1024):
        d = squared(c[i:i + 1024], c)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i:i + 1024] = np.argpartition(d, min(near, n - 1) - 1, axis=1)[:, :near] if n > 1 else 0
    strides = np.unique(np.round(np.geomspace(1, max(1, n // 2), degree - near)).astype(int)) if degree > near else np.array([1])
    ring = (np.arange(n)[:, None] + strides[None]) % n
    return np.hstack([out, ring.astype(np.int32)])


def search_graph(x: np.ndarray, c: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the centroid graph for all rows of ``x`` at once: (ids, squared distances), nearest first; with a
    beam as wide as the graph all centroids are found."""
    ids, dist = [], []
    beam = min(beam, len(c))
    norm = (c * c).sum(axis=1)
    for i in range(0, len(x), step):
        q = x[i:i + step]
        rows = np.arange(len(q))[:, None]
        q2 = (q * q).sum(axis=1)[:, None]
        seen = np.zeros((len(q), len(c)), dtype=bool)
        seen[:, entry] = True
        d = q2 + norm[entry] - 2 * q @ c[entry].T
        best = np.argsort(d, axis=1)[:, :beam]
        d, at, done = np.take_along_axis(d, best, 1), entry[best], np.zeros(best.shape, dtype=bool)
        pad = ((0, 0), (0, beam - best.shape[1]))
        d, at, done = np.pad(d, pad, constant_values=np.inf), np.pad(at, pad), np.pad(done, pad, constant_values=True)
        while not done.all():
            open_d = np.where(done, np.inf, d)
            pick = open_d.argmin(axis=1)[:, None]
            live = np.isfinite(np.take_along_axis(open_d, pick, 1))
            np.put_along_axis(done, pick, True, 1)
            new = links[np.take_along_axis(at, pick, 1)[:, 0]]
            fresh = ~seen[rows, new] & live
            seen[rows, new] = True
            nd = np.where(fresh, q2 + norm[new] - 2 * np.einsum("qd,qnd->qn", q, c[new]), np.inf)
            d, at, done = np.hstack([d, nd]), np.hstack([at, new]), np.hstack([done, ~fresh])
            best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            d, at, done = (np.take_along_axis(z, best, 1) for z in (d, at, done))
        order = np.argsort(d, axis=1)
        ids.append(np.take_along_axis(at, order, 1))
        dist.append(np.maximum(np.take_along_axis(d, order, 1), 0))  # places that no centroid took stay infinite
    return np.concatenate(ids), np.concatenate(dist)


def entry_points(c: np.ndarray, n: int = 64) -> np.ndarray:
    """Farthest-first centroids: remote ones, which few links reach, come first."""
    out = [int(np.argmax(((c - c.mean(axis=0)) ** 2).sum(axis=1)))]
    d = ((c - c[out[0]]) ** 2).sum(axis=1)
    while len(out) < min(n, len(c)):
        out.append(int(d.argmax()))
        d = np.minimum(d, ((c - c[out[-1]]) ** 2).sum(axis=1))
    return np.unique(out)


def choose_lists(ids: np.ndarray, d: np.ndarray, most: int, ratio: float, least: int = 1) -> list[np.ndarray]:
    """Of centroids in order of distance: those within ``ratio`` of the nearest, ``most`` at most and ``least`` at least."""
    keep = d <= d[:, :1] * ratio ** 2 + 1e-12
    keep[:, :least], keep[:, most:] = True, False
    keep &= np.isfinite(d)
    return [i[m] for i, m in zip(ids, keep, strict=True)]


def group_lists(c: np.ndarray, most: int = GROUP) -> np.ndarray:
    """Group of every centroid: halved along the axis of largest spread until a part has at most ``most``."""
    out, n, parts = np.zeros(len(c), dtype=np.int32), 0, [np.arange(len(c))]
    while parts:
        part = parts.pop()
        if len(part) <= most:
            out[part] = n
            n += 1
            continue
        x = c[part] - c[part].mean(axis=0)
        order = np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")
        parts += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
    return out


def valid(vec: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(col) -> np.ndarray:
    return np.stack(list(col)).astype(np.float64) if len(col) else np.zeros((0, 1))


def _rows_of(schema: str, *columns) -> pd.DataFrame:
    return pd.DataFrame(dict(zip([x.split()[0] for x in schema.split(", ")], columns, strict=True)))


def _flat(names: pd.Series, ids: np.ndarray, d: np.ndarray, most: int, ratio: float, least: int = 1):
    """(name, id, rank, ratio to the nearest, squared distance) of the chosen ones of every row."""
    chosen = choose_lists(ids, d, most, ratio, least)
    sizes = np.array([len(x) for x in chosen])
    rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(names)), sizes)
    dist = d[row, rank]
    return names.to_numpy()[row], np.concatenate(chosen), rank, np.sqrt(dist / np.maximum(d[row, 0], 1e-12)), dist


ROUTED = "c long, cell int, cell_rank int, cell_ratio double"
FOUND = "c long, cell int, cell_rank int, cell_ratio double, list int, g long, d double"
FINE = "cell int, list int, g long, centroid array<double>"


class Index:
    """Cells, whose centroids are fitted on a bounded sample and broadcast as a graph, and each cell's lists, fitted in a task per cell.

    There are about as many cells as lists a cell, so neither the broadcast nor a task's graph grows faster than the root of the table.
    """

    def __init__(self, vecs: DataFrame, n: int, top: float, sample: int, list_size: int):
        self.spark, self.top, self.list_size = vecs.sparkSession, top, list_size
        part = vecs.select("v").where(F.pmod(F.xxhash64("c", F.lit(1)), F.lit(1 << 20)) < F.lit(int(min(1.0, 1.5 * sample / n) * (1 << 20)) + 1)).limit(sample)
        points = lift(_matrix([r.v for r in part.collect()]), top)
        self.n_cells = max(1, min(MOST_CELLS, len(points) // 8, round((n / list_size) ** 0.5)))
        c = fit_centroids(points, self.n_cells)
        self.n_cells = len(c)
        self.cells = self.spark.sparkContext.broadcast((c, link_centroids(c), entry_points(c)))
        self.lists = self._fit_lists(vecs)

    def route(self, vecs: DataFrame, most: int, ratio: float, queries: bool = False) -> DataFrame:
        """ROUTED rows with ``v``: the nearest cells of every vector."""
        cells, lifted = self.cells, self._lifter(queries)

        def routed(batches):
            c, links, entry = cells.value
            for pdf in batches:
                if len(pdf):
                    ids, d = search_graph(lifted(pdf["v"]), c, links, entry, max(BEAM, most))
                    name, cell, rank, near, _ = _flat(pdf["c"], ids, d, most, ratio)
                    out = _rows_of(ROUTED, name, cell, rank, near)
                    out["v"] = pdf["v"].to_numpy()[np.repeat(np.arange(len(pdf)), np.diff(np.r_[np.flatnonzero(rank == 0), len(rank)]))]
                    yield out

        return vecs.select("c", "v").mapInPandas(routed, ROUTED + ", v array<double>")

    def _lifter(self, queries: bool):
        top = self.top

        def lifted(col) -> np.ndarray:
            x = _matrix(col)
            if not queries:
                return lift(x, top)
            return np.hstack([x * (top / np.sqrt((x * x).sum(axis=1, keepdims=True))), np.zeros((len(x), 1))])

        return lifted

    def _fit_lists(self, vecs: DataFrame) -> DataFrame:
        """FINE rows: the lists of each cell, about one per ``list_size`` of its vectors, fitted on ``SAMPLE`` of them at most."""
        own = materialize(self.route(vecs, 1, 1.0), "ann-own")
        sizes = own.groupBy("cell").agg(F.count("*").alias("size"))
        some = own.join(F.broadcast(sizes), "cell")  # a row per cell, of which there are at most MOST_CELLS
        some = some.where(F.pmod(F.xxhash64("c", F.lit(2)), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("size")) * (1 << 20))
        lifted, list_size = self._lifter(False), self.list_size

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            cell, c = int(pdf["cell"].iloc[0]), fit_centroids(lifted(pdf["v"]), max(1, round(int(pdf["size"].iloc[0]) / list_size)))
            return _rows_of(FINE, np.full(len(c), cell, dtype=np.int32), np.arange(len(c), dtype=np.int32), cell * np.int64(1 << 20) + group_lists(c), list(c))

        lists = materialize(some.select("cell", "size", "v").groupBy("cell").applyInPandas(fit, FINE), "ann-lists")
        discard(own)
        return lists

    def place(self, routed: DataFrame, most: int, ratio: float, queries: bool = False, least: int = 1) -> DataFrame:
        """FOUND rows: of the lists in a vector's cells, the nearest.  Vectors of a large cell are dealt out in shards; its centroids go to all."""
        routed = materialize(routed, "ann-routed")
        shards = routed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("n"))
        shards = materialize(shards, "ann-shards")
        v = routed.join(F.broadcast(shards), "cell").withColumn("shard", F.pmod(F.xxhash64("c"), "n").cast("int")).drop("n")
        c = self.lists.join(F.broadcast(shards), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        lifted = self._lifter(queries)

        def placed(x: pd.DataFrame, fine: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(fine):
                return _rows_of(FOUND, *[[]] * 7)
            fine = fine.sort_values("list")
            c, groups = _matrix(fine["centroid"]), fine["g"].to_numpy()
            ids, d = search_graph(lifted(x["v"]), c, link_centroids(c), entry_points(c), max(BEAM, most))
            name, one, _, _, dist = _flat(pd.Series(np.arange(len(x))), ids, d, most, ratio, least)
            return _rows_of(FOUND, *[x[n].to_numpy()[name] for n in ("c", "cell", "cell_rank", "cell_ratio")], one, groups[one], dist)

        found = v.groupBy("cell", "shard").cogroup(c.groupBy("cell", "shard")).applyInPandas(placed, FOUND)
        by = Window.partitionBy("c")
        found = found.withColumn("rank", F.row_number().over(by.orderBy("d", "cell", "list"))).withColumn("ratio", F.sqrt(F.col("d") / F.greatest(F.min("d").over(by), F.lit(1e-12))))
        out = materialize(found.where((F.col("rank") <= least) | (F.col("rank") <= most) & (F.col("ratio") <= ratio + 1e-9)), "ann-placed")
        discard(routed, shards)
        return out


def exact(vecs: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(q, c, score): the ``k`` largest inner products of each of a bounded number of queries (class, vector) over all other vectors."""
    names, m = np.array([q for q, _ in asked], dtype=np.int64), _matrix([v for _, v in asked])

    def best(batches):
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            c, score = pdf["c"].to_numpy(), m @ _matrix(pdf["v"]).T
            score = np.where(names[:, None] == c[None], -np.inf, score)
            some = min(k + 12, len(c))
            at = np.argpartition(-score, some - 1, axis=1)[:, :some]
            now = pd.DataFrame({"q": np.repeat(names, some), "c": c[at].ravel(), "score": np.take_along_axis(score, at, 1).ravel()})
            now = now[np.isfinite(now["score"])] if held is None else pd.concat([held, now[np.isfinite(now["score"])]])
            held = now.sort_values(["q", "score", "c"], ascending=[True, False, True]).groupby("q", sort=False).head(k)
        if held is not None:
            yield held

    found = vecs.mapInPandas(best, "q long, c long, score double")
    return found.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("at") <= k).drop("at")


def tune(index: Index, vecs: DataFrame, asked: DataFrame, postings: DataFrame, k: int, recall: float) -> tuple[int, float, int, float]:
    """(cells, ratio of cells, lists, ratio of lists) with which ``TUNED`` queries find ``recall`` of their true neighbours in the whole table.

    Queries look at ever more cells until all but a quarter of 1 - ``recall`` of the neighbours are seen; those that aren't count as infinitely far.
    """
    some = materialize(asked.orderBy(F.xxhash64("c", F.lit(3))).limit(TUNED).select("c", "v"), "ann-tuned")
    rows = [(r.c, list(r.v)) for r in some.collect()]
    true = materialize(exact(vecs, rows, k).select("q", "c"), "ann-true")
    held = materialize(true.join(postings.select("c", "cell", "list"), "c"), "ann-held")
    n, n_lists, part = true.count(), index.lists.count(), 1 - (1 - recall) / 4
    if not n:
        return WIDE, float("inf"), WIDE, float("inf")
    cells = min(index.n_cells, WIDE)
    while True:
        most = n_lists if cells == index.n_cells else 16 * cells
        wide = index.place(index.route(some, cells, np.inf, queries=True), most, np.inf, queries=True)
        seen = held.join(wide.select(F.col("c").alias("q"), "cell", "list", "cell_rank", "cell_ratio", "rank", "ratio"), ["q", "cell", "list"])
        best = seen.groupBy("q", "c").agg(F.min_by(F.struct("cell_rank", "cell_ratio", "rank", "ratio"), "rank").alias("b")).select("b.*").toPandas()  # TUNED * k rows at most
        if len(best) > part * n or cells == index.n_cells:
            break
        cells = min(index.n_cells, 2 * cells)

    def at(column: str) -> float:
        missed = np.full(n - len(best), np.inf)  # true neighbours in lists farther than those looked at
        return float(np.quantile(np.r_[best[column].to_numpy(float), missed], part, method="higher"))

    reach = at("cell_rank")
    if not np.isfinite(reach):
        return index.n_cells, float("inf"), n_lists, float("inf")
    return int(reach) + 1, at("cell_ratio"), int(at("rank")), at("ratio")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec: str = "embedding", list_size: int = LIST_SIZE,
            sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` largest inner products found for each row that satisfies ``is_query``, ties to the smaller id."""
    schema = f"query_id long, rank int, {id_col} long, score double"
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vec}`"), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v")))
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if dim is None:
        return spark.createDataFrame([], schema)
    rows = materialize(rows.where(F.size("v") == dim["n"]).distinct(), "ann-rows")

    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    classes = materialize(ranked.groupBy("v").agg(F.min("id").alias("c"), F.sort_array(F.collect_list("id")).alias("ids")), "ann-classes")
    queries = materialize(rows.where("q").select("id", "v").join(classes.select("v", "c"), "v").select("id", "c"), "ann-queries")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
    if queries.isEmpty():
        return spark.createDataFrame([], schema)

    vecs = classes.select("c", "v")
    index = Index(vecs, stats.n, float(stats.top), sample, list_size)
    postings = index.place(index.route(vecs, REPLICAS, BOUNDARY), REPLICAS, BOUNDARY)
    asked = materialize(vecs.join(queries.select("c").distinct(), "c", "left_semi"), "ann-asked")
    cells, cell_ratio, lists, ratio = tune(index, vecs, asked, postings, k, recall)
    def by_group(x: DataFrame) -> DataFrame:
        return x.groupBy("c", "g").agg(F.collect_list("list").alias("lists"))

    postings, keep = materialize(by_group(postings), "ann-postings"), k + 1
    by = ["g", "vs", "qs"]

    def scan(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"q": [], "c": [], "score": []})
        mv, mq, names = _matrix(v["v"]), _matrix(q["v"]), v["c"].to_numpy()
        of_v, of_q = (pd.Series(np.repeat(np.arange(len(x)), x["lists"].map(len))).groupby(np.concatenate(list(x["lists"]))).apply(np.array) for x in (v, q))
        pairs = []
        for one in of_v.index.intersection(of_q.index):
            at_v, at_q = of_v[one], of_q[one]
            some = min(len(at_v), keep + 11)
            best = np.argpartition(-(mq[at_q] @ mv[at_v].T), some - 1, axis=1)[:, :some]
            pairs.append(np.repeat(at_q, some) * len(mv) + at_v[best.ravel()])
        at_q, at_v = np.divmod(np.unique(np.concatenate([*pairs, np.array([], dtype=np.int64)])).astype(np.int64), len(mv))
        score = np.concatenate([np.einsum("ij,ij->i", mq[at_q[i:i + 65536]], mv[at_v[i:i + 65536]]) for i in range(0, len(at_q), 65536)] or [np.array([])])
        out = pd.DataFrame({"q": q["c"].to_numpy()[at_q], "c": names[at_v], "score": score})
        return out.sort_values(["q", "score", "c"], ascending=[True, False, True]).groupby("q", sort=False).head(keep)

    def search(some: DataFrame, cells: int, cell_ratio: float, lists: int, ratio: float, least: int) -> DataFrame:
        """(q, c, score): the best of each query in its nearest lists."""
        wanted = index.place(index.route(some, cells, cell_ratio, queries=True), lists, ratio, queries=True, least=least)
        wanted = materialize(by_group(wanted), "ann-probes")
        # A row per group of lists: shards of each group and of its queries.
        shards = materialize(postings.groupBy("g").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("vs"))
                             .join(wanted.groupBy("g").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("qs")), "g"), "ann-shards")

        def dealt(x: DataFrame, own: str, other: str) -> DataFrame:
            return (x.join(shards, "g").withColumn(own, F.pmod(F.xxhash64("c"), F.col(own)).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).join(vecs, "c").select(*[F.col(n).alias(n) for n in (*by, "c", "lists", "v")]))

        found = dealt(postings, "vs", "qs").groupBy(*by).cogroup(dealt(wanted, "qs", "vs").groupBy(*by)).applyInPandas(scan, "q long, c long, score double")
        found = found.groupBy("q", "c").agg(F.max("score").alias("score"))
        top = Window.partitionBy("q").orderBy(F.desc("score"), "c")
        return materialize(found.withColumn("at", F.row_number().over(top)).where(F.col("at") <= keep).drop("at"), "ann-found")

    enough = min(keep, stats.n)
    found = search(asked, cells, cell_ratio, max(lists, LEAST_LISTS), ratio, LEAST_LISTS)
    for more in MORE:  # lists for the queries whose own hold too few vectors
        short = short_queries(found, asked, enough)
        if short.isEmpty():
            break
        least = LEAST_LISTS * more
        again = search(short, min(index.n_cells, max(cells, more)), float("inf"), max(lists, least), ratio, least)
        found = materialize(found.join(short.select(F.col("c").alias("q")), "q", "left_anti").unionByName(again), "ann-found")
    found = with_short_queries(found, vecs, asked, enough, keep)

    ids = found.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("id"))
    ids = ids.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("at") <= keep)
    answers = materialize(ids.select(F.col("q").alias("c"), F.col("id").alias("near"), "score"), "ann-answers")
    own = queries.join(answers, "c").where("id != near")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "near"))
    return own.select(F.col("id").alias("query_id"), rank.alias("rank"), F.col("near").alias(id_col), "score").where(F.col("rank") <= k)


def short_queries(found: DataFrame, asked: DataFrame, enough: int) -> DataFrame:
    """The (c, v) of ``asked`` that have fewer than ``enough`` answers."""
    full = found.groupBy("q").count().where(F.col("count") >= enough)
    return materialize(asked.join(full, F.col("c") == F.col("q"), "left_anti").select("c", "v"), "ann-short")


def with_short_queries(found: DataFrame, vecs: DataFrame, asked: DataFrame, enough: int, keep: int, step: int = 512) -> DataFrame:
    """``found`` with the answers of queries whose lists held fewer than ``enough`` classes replaced by those of an exact search, in blocks of about ``step`` queries."""
    short = short_queries(found, asked, enough)
    n = short.count()
    parts = [found] if n == 0 else [found.join(short.select(F.col("c").alias("q")), "q", "left_anti")]
    blocks = -(-n // step)
    for i in range(blocks):
        rows = [(r.c, list(r.v)) for r in short.where(F.pmod(F.xxhash64("c", F.lit(4)), F.lit(blocks)) == i).collect()]
        if rows:
            own = vecs.join(F.broadcast(vecs.sparkSession.createDataFrame([(r[0],) for r in rows], "q long")), F.col("c") == F.col("q"))
            itself = own.select("q", "c", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("score"))
            parts.append(materialize(exact(vecs, rows, keep).unionByName(itself), "ann-exact"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("q", "c", "score"))
    return out
