"""Boosted leaf-wise trees on binned features, for squared error and for quantiles.

Features are binned once; the table of bins is written once and serves any number of models at the same time (``Task``: folds, quantiles), each with
training rows of its own.  A pass over it adds up the histograms (sum of gradients, rows) of the leaves that every model has open: tasks add within their
partition, then Spark brings the histograms of a leaf and a block of features together, adds them and finds the best split, so that the driver gets one row
for each.  Leaves are split in the order of their gain, the best next.  A pass looks at the children of all leaves that may still be split,
which takes about as many passes as the tree is deep and gives the same tree as one pass a split.

With the pinball loss the gradient is a sign, and the value of a leaf is the quantile of its residuals, from a sketch per leaf.

Rows keep the sum of the trees so far, brought up to date every ``RESTAGE`` trees; the trees since then are small and travel with the tasks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, stage

#: Features whose histograms travel together.
BLOCK = 16
#: Trees after which the rows' sums are written again.
RESTAGE = 16
#: Error of the ranks of bin bounds, base values and leaf quantiles: 1 / ``ACCURACY`` of the rows.
ACCURACY = 10_000
TRAIN, HELD = 1, 2


@dataclass(frozen=True)
class Params:
    """How trees are grown; boosting stops once the loss of held-out rows hasn't fallen by ``tolerance`` in ``patience`` trees."""

    learning_rate: float = 0.05
    max_iter: int = 1500
    max_depth: int = 10
    max_leaves: int = 63
    min_rows: int = 50
    l2: float = 1.0
    max_bins: int = 255
    patience: int = 50
    tolerance: float = 1e-7
    subsample: float = 1.0
    seed: int = 42


def quantile_params(**changes) -> Params:
    """For intervals: fewer and shallower trees, larger steps, four fifths of the rows for each."""
    return Params(**({"learning_rate": 0.1, "max_iter": 200, "max_depth": 6, "max_leaves": 64, "min_rows": 1, "l2": 0.0, "subsample": 0.8} | changes))


@dataclass(frozen=True)
class Task:
    """A model to fit: on the rows where ``train`` holds, except those where ``held`` holds too, which only decide when to stop."""

    name: str
    train: Column
    held: Column | None = None
    quantile: float | None = None


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1.  Rows whose bin is at most ``bin`` go left."""

    feature: list[int]
    bin: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float] = field(default_factory=list)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        feature, cut, left, right = (np.asarray(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        at = np.arange(len(bins)) if feature[0] >= 0 else np.array([], np.int64)
        while len(at):
            n = node[at]
            n = np.where(bins[at, feature[n]] <= cut[n], left[n], right[n])
            node[at] = n
            at = at[feature[n] >= 0]
        return node


@dataclass
class Model:
    """Upper bounds of all bins but the last per feature, and trees whose values are added to ``base``."""

    features: list[str]
    bounds: list[list[float]]
    base: float
    trees: list[Tree]
    losses: list[float]

    def predict(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.bounds)
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += np.asarray(t.value)[t.leaves(bins)]
        return out

    def importance(self) -> dict[str, float]:
        """Share of each feature in the gains of all splits."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += g
        whole = sum(total.values())
        return {f: g / whole if whole else 0.0 for f, g in total.items()}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(**(d | {"trees": [Tree(**t) for t in d["trees"]]}))


def binned(values: np.ndarray, bounds: Sequence[Sequence[float]]) -> np.ndarray:
    if not bounds:
        return np.zeros((len(values), 0), np.uint8)
    return np.stack([np.searchsorted(np.asarray(b, float), values[:, i], "left") for i, b in enumerate(bounds)], 1).astype(np.uint8)


def bin_bounds(df: DataFrame, features: list[str], max_bins: int = 255) -> list[list[float]]:
    """Values that split each feature into at most ``max_bins`` parts of like size, of all features in one aggregate."""
    if not 2 <= max_bins <= 256:
        raise ValueError("max_bins must be from 2 to 256")
    shares = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, ACCURACY).alias(f"q{i}") for i, f in enumerate(features)],
                 *[F.max(F.col(f"`{f}`").cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [sorted({v for v in row[f"q{i}"] or [] if v < row[f"m{i}"]}) for i in range(len(features))]


def _uniform(u: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row's hash and each tree."""
    z = u + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _table(df: DataFrame, target: str, features: list[str], bounds: list[list[float]], tasks: list[Task], seed: int) -> DataFrame:
    """Staged (x, y, u, roles): bins and role of each row in each task, as bytes; rows without target or role are left out."""
    roles = [F.when(F.coalesce(t.train, F.lit(False)), F.when(F.coalesce(t.held, F.lit(False)), HELD).otherwise(TRAIN)).otherwise(0) if t.held is not None
             else F.when(F.coalesce(t.train, F.lit(False)), TRAIN).otherwise(0) for t in tasks]
    values = [F.col(f"`{f}`").cast("double") for f in features]
    y = F.col(f"`{target}`").cast("double")
    rows = df.select(F.array(*values).alias("v"), y.alias("y"), F.xxhash64(F.lit(seed), y, *values).alias("u"), F.array(*[r.cast("int") for r in roles]).alias("roles"))
    rows = rows.where(F.col("y").isNotNull() & F.exists("roles", lambda r: r > 0))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("v").flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            bins = binned(np.nan_to_num(values, nan=0.0), bounds)
            roles = b.column("roles").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(b.num_rows, -1)
            x, of = (pa.array([r.tobytes() for r in m], pa.binary()) for m in (bins, roles))
            yield pa.RecordBatch.from_arrays([x, b.column("y"), b.column("u"), of], names=["x", "y", "u", "roles"])

    return stage(rows.mapInArrow(packed, "x binary, y double, u long, roles binary"), "boost-bins")


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    """Matrix of a column of equally long byte strings."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(kind).reshape(len(column), -1)


@dataclass
class _State:
    """Of one task: its trees, and those that the table's sums don't hold yet."""

    quantile: float | None
    base: float
    trees: list[Tree] = field(default_factory=list)
    fresh: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    stopped: bool = False


def _decoded(batch: pa.RecordBatch, states: list[_State]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, targets, row hashes, roles and the current sums of a batch."""
    x, roles = _bytes(batch.column("x"), np.uint8), _bytes(batch.column("roles"), np.uint8)
    y, u = batch.column("y").to_numpy(zero_copy_only=False), batch.column("u").to_numpy(zero_copy_only=False).view(np.uint64)
    sums = _bytes(batch.column("sums"), np.float64).copy() if "sums" in batch.schema.names else np.tile([s.base for s in states], (len(y), 1)).astype(float)
    for m, s in enumerate(states):
        for t in s.fresh:
            sums[:, m] += np.asarray(t.value)[t.leaves(x)]
    return x, y, u, roles, sums


def _loss(quantile: float | None, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    d = y - f
    return d * d / 2 if quantile is None else np.maximum(quantile * d, (quantile - 1) * d)


class _Growth:
    """A tree that grows: nodes with their rows and gradients, the best split of those that were looked at."""

    def __init__(self, p: Params):
        self.p = p
        self.depth, self.g, self.n = [0], [0.0], [0.0]
        self.split: list[tuple[float, int, int, float, float] | None] = [None]  # gain, feature, bin, gradients and rows left
        self.seen, self.children, self.path = [False], [None], [""]

    def key(self, i: int) -> tuple[float, str, int]:
        """Order of open leaves: the largest gain, and of gains that differ by rounding only the leftmost leaf."""
        return -float(f"{self.split[i][0]:.9e}"), self.path[i], i

    def splittable(self, i: int) -> bool:
        return self.depth[i] < self.p.max_depth and self.n[i] >= 2 * self.p.min_rows

    def expand(self, i: int) -> tuple[int, int]:
        if self.children[i] is None:
            _, _, _, g, n = self.split[i]
            for side, a, b in (("0", g, n), ("1", self.g[i] - g, self.n[i] - n)):
                self.path.append(self.path[i] + side)
                self.depth.append(self.depth[i] + 1)
                self.g.append(a)
                self.n.append(b)
                self.split.append(None)
                self.seen.append(False)
                self.children.append(None)
            self.children[i] = (len(self.g) - 2, len(self.g) - 1)
        return self.children[i]

    def _likely(self) -> list[int]:
        """Nodes that the tree may split: of all known splits those with the largest gains, a node's no larger than its parent's.

        Splitting the best leaf next comes to the same nodes, so as more become known, others can only drop out.
        """
        reach = {0: self.split[0][0]} if self.split[0] else {}
        todo = list(reach)
        while todo:
            i = todo.pop()
            for c in self.children[i] or ():
                if self.split[c]:
                    reach[c] = min(reach[i], self.split[c][0])
                    todo.append(c)
        return heapq.nsmallest(self.p.max_leaves - 1, reach, key=lambda i: (-float(f"{reach[i]:.9e}"), self.path[i]))

    def open(self) -> tuple[list[int], list[int]]:
        """(chosen splits, nodes to look at): splits best first; while there are nodes to look at, more may follow."""
        if not self.seen[0]:
            return [], [0]
        wanted = [c for i in self._likely() for c in self.expand(i) if not self.seen[c] and self.splittable(c)]
        if wanted:
            return [], wanted
        chosen, leaves = [], 1
        heap = [self.key(0)] if self.split[0] else []
        while heap and leaves < self.p.max_leaves:
            *_, i = heapq.heappop(heap)
            chosen.append(i)
            leaves += 1
            for c in self.expand(i):
                if not self.seen[c] and self.splittable(c) and leaves < self.p.max_leaves:
                    wanted.append(c)
                elif self.split[c]:
                    heapq.heappush(heap, self.key(c))
            if wanted:
                break
        return chosen, wanted

    def routing(self) -> Tree:
        """All that has been expanded so far, also what won't be chosen."""
        inner = [c is not None for c in self.children]
        return Tree([s[1] if k else -1 for s, k in zip(self.split, inner, strict=True)], [s[2] if k else 0 for s, k in zip(self.split, inner, strict=True)],
                    [c[0] if c else -1 for c in self.children], [c[1] if c else -1 for c in self.children], [])

    def tree(self, chosen: list[int], values: bool) -> Tree:
        """The chosen splits; with ``values`` the leaves have their gradient steps."""
        inner, out = set(chosen), Tree([], [], [], [], [], [])

        def add(i: int) -> int:
            k = len(out.feature)
            for column, x in ((out.feature, -1), (out.bin, 0), (out.left, -1), (out.right, -1), (out.gain, 0.0)):
                column.append(x)
            out.value.append(-self.p.learning_rate * self.g[i] / (self.n[i] + self.p.l2) if values and self.n[i] else 0.0)
            return k

        stack = [(0, add(0))]
        while stack:
            i, k = stack.pop()
            if i in inner:
                gain, out.feature[k], out.bin[k], _, _ = self.split[i]
                out.gain[k], out.value[k] = gain, 0.0
                a, b = self.children[i]
                out.left[k], out.right[k] = add(a), add(b)
                stack += [(a, out.left[k]), (b, out.right[k])]
        return out


def _histograms(table: DataFrame, states: list[_State], growths: list[_Growth | None], wanted: list[list[int]], p: Params, bins: int, features: int, number: int) -> DataFrame:
    """(task, node, block, g, n) of each partition; block -1 holds the loss and number of held-out rows, at the root."""
    routes = [g.routing() if g and w else None for g, w in zip(growths, wanted, strict=True)]

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = [np.zeros((features, len(w), bins)) for w in wanted]
        n = [np.zeros((features, len(w), bins)) for w in wanted]
        held = np.zeros((len(states), 2))
        for batch in batches:
            x, y, u, roles, sums = _decoded(batch, states)
            for m, w in enumerate(wanted):
                if not w:
                    continue
                if w == [0]:
                    out = roles[:, m] == HELD
                    held[m] += _loss(states[m].quantile, y[out], sums[out, m]).sum(), out.sum()
                use = roles[:, m] == TRAIN
                if p.subsample < 1:
                    use &= _uniform(u, p.seed, number) < p.subsample
                slots = np.full(len(routes[m].feature), -1)
                slots[w] = np.arange(len(w))
                at = np.flatnonzero(use)
                slot = slots[routes[m].leaves(x[at])]
                at, slot = at[slot >= 0], slot[slot >= 0]
                d = sums[at, m] - y[at]
                if states[m].quantile is not None:
                    d = np.where(d >= 0, 1 - states[m].quantile, -states[m].quantile)
                base = slot * bins
                for f in range(features):
                    key = base + x[at, f]
                    g[m][f] += np.bincount(key, d, len(w) * bins).reshape(len(w), bins)
                    n[m][f] += np.bincount(key, minlength=len(w) * bins).reshape(len(w), bins)
        rows = [(m, i, f, g[m][f:f + BLOCK, j].tobytes(), n[m][f:f + BLOCK, j].tobytes())
                for m, w in enumerate(wanted) for j, i in enumerate(w) for f in range(0, features, BLOCK) if n[m][f, j].any()]
        rows += [(m, 0, -1, held[m, :1].tobytes(), held[m, 1:].tobytes()) for m, w in enumerate(wanted) if w == [0]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["task", "node", "block", "g", "n"])

    return table.mapInArrow(added, "task int, node int, block int, g binary, n binary")


def _best(block: int, g: np.ndarray, n: np.ndarray, bins: int, p: Params) -> tuple:
    """(gain, feature, bin, gradients and rows left, gradients and rows) of a node by a block of features; no gain: feature -1."""
    g, n = g.reshape(-1, bins), n.reshape(-1, bins)
    left_g, left_n = np.cumsum(g, 1), np.cumsum(n, 1)
    all_g, all_n = left_g[0, -1], left_n[0, -1]
    right_g, right_n = all_g - left_g, all_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2 / (left_n + p.l2) + right_g ** 2 / (right_n + p.l2) - all_g ** 2 / (all_n + p.l2)
    gain = np.where((left_n >= max(p.min_rows, 1)) & (right_n >= max(p.min_rows, 1)), gain, -np.inf)
    # Gains that differ by rounding only are equal: the first feature and bin win, in whatever order partitions were added.
    top = gain.max()
    if not top > 1e-9 * max(1.0, abs(all_g)):
        return 0.0, -1, 0, 0.0, 0.0, float(all_g), float(all_n)
    f, b = (int(k) for k in np.argwhere(gain >= top - 1e-9 * top)[0])
    return float(gain[f, b]), block + f, b, float(left_g[f, b]), float(left_n[f, b]), float(all_g), float(all_n)


def _splits(histograms: DataFrame, bins: int, p: Params) -> list:
    """Best split by task, node and block, found where the histograms of each are added; a few rows reach the driver."""
    names = ["task", "node", "block"]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
    columns = [*names, "gain", "feature", "bin", "left_g", "left_n", "g", "n"]

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, g, n, out = None, None, None, []

        def done() -> None:
            if key is not None:
                out.append((*key, *(_best(key[2], g, n, bins, p) if key[2] >= 0 else (0.0, -1, 0, 0.0, 0.0, float(g[0]), float(n[0])))))

        for batch in batches:
            for *k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a), np.frombuffer(b)
                if k == key:
                    g, n = g + a, n + b
                else:
                    done()
                    key, g, n = k, a, b
        done()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 10, kinds, strict=True)], names=columns)

    schema = "task int, node int, block int, gain double, feature int, bin int, left_g double, left_n double, g double, n double"
    return histograms.repartition(*names).sortWithinPartitions(*names).mapInArrow(found, schema).collect()


def _grow(table: DataFrame, states: list[_State], p: Params, bins: int, features: int, number: int) -> list[Tree | None]:
    """The next tree of every task that goes on; the losses of held-out rows before it are noted."""
    growths = [None if s.stopped else _Growth(p) for s in states]
    chosen: list[list[int]] = [[] for _ in states]
    while True:
        wanted: list[list[int]] = [[] for _ in states]
        for m, g in enumerate(growths):
            if g:
                chosen[m], wanted[m] = g.open()
        if not any(wanted):
            break
        rows = _splits(_histograms(table, states, growths, wanted, p, bins, features, number), bins, p)
        for m, w in enumerate(wanted):
            for i in w:
                growths[m].seen[i] = True
        for r in sorted(rows, key=lambda r: (r.task, r.node, r.block)):
            g = growths[r.task]
            if r.block < 0:
                if r.n:
                    states[r.task].losses.append(r.g / r.n)
                continue
            g.g[r.node], g.n[r.node] = r.g, r.n
            if r.feature >= 0 and (g.split[r.node] is None or r.gain > g.split[r.node][0] * (1 + 1e-9)):
                g.split[r.node] = (r.gain, r.feature, r.bin, r.left_g, r.left_n)
    return [g.tree(c, states[m].quantile is None) if g else None for m, (g, c) in enumerate(zip(growths, chosen, strict=True))]


def _leaf_quantiles(table: DataFrame, states: list[_State], trees: list[Tree | None], p: Params, number: int) -> None:
    """Sets the leaves of quantile tasks to the quantile of the residuals of their rows."""
    ours = [m for m, t in enumerate(trees) if t and states[m].quantile is not None]
    if not ours:
        return

    def residuals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, u, roles, sums = _decoded(batch, states)
            for m in ours:
                use = roles[:, m] == TRAIN
                if p.subsample < 1:
                    use &= _uniform(u, p.seed, number) < p.subsample
                at = np.flatnonzero(use)
                columns = (np.full(len(at), m, np.int32), trees[m].leaves(x[at]).astype(np.int32), y[at] - sums[at, m])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["task", "leaf", "r"])

    levels = sorted({states[m].quantile for m in ours})
    rows = table.mapInArrow(residuals, "task int, leaf int, r double").groupBy("task", "leaf").agg(F.percentile_approx("r", levels, ACCURACY).alias("q")).collect()
    for r in rows:
        trees[r.task].value[r.leaf] = p.learning_rate * r.q[levels.index(states[r.task].quantile)]


def _restaged(table: DataFrame, states: list[_State]) -> DataFrame:
    """The table with the sums of all trees so far."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = _decoded(b, states)[4]
            kept = [b.column(c) for c in ("x", "y", "u", "roles")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in sums], pa.binary())], names=["x", "y", "u", "roles", "sums"])

    out = stage(table.mapInArrow(summed, "x binary, y double, u long, roles binary, sums binary"), "boost-sums")
    for s in states:
        s.trees, s.fresh = s.trees + s.fresh, []
    discard(table)
    return out


def out_of_patience(losses: list[float], patience: int, tolerance: float) -> bool:
    """Whether none of the last ``patience`` losses is below the one before them by more than ``tolerance``."""
    return len(losses) > patience and min(losses[-patience:]) >= losses[-patience - 1] - tolerance


def fit(df: DataFrame, target: str, features: list[str], tasks: list[Task], params: Params | None = None, bounds: list[list[float]] | None = None) -> dict[str, Model]:
    """A model per task, all of them fitted side by side in the same passes over one table of bins.

    Null and NaN features count as 0, rows without target are left out.  A task without training rows is an error.  Bins are those of all rows in
    any task, unless ``bounds`` gives them.
    """
    p = params or Params()
    if len({t.name for t in tasks}) < len(tasks):
        raise ValueError("tasks need different names")
    used = F.lit(False)
    for t in tasks:
        used = used | F.coalesce(t.train, F.lit(False))
    if bounds is None:
        zeroed = df.where(used).select(*[F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
        bounds = bin_bounds(zeroed, features, p.max_bins)
    table = _table(df.where(used), target, features, bounds, tasks, p.seed)
    y, role = F.col("y"), [F.hex(F.substring("roles", m + 1, 1)) == "01" for m in range(len(tasks))]
    known = [F.when(r, y) for r in role]
    start = [F.avg(x) if t.quantile is None else F.percentile_approx(x, t.quantile, ACCURACY) for t, x in zip(tasks, known, strict=True)]
    first = table.agg(*[b.alias(f"b{m}") for m, b in enumerate(start)]).first()
    if None in tuple(first):
        raise ValueError("no training rows: " + ", ".join(t.name for t, b in zip(tasks, first, strict=True) if b is None))
    states = [_State(t.quantile, float(b)) for t, b in zip(tasks, first, strict=True)]
    bins = 1 + max(map(len, bounds), default=0)
    for number in range(p.max_iter):
        trees = _grow(table, states, p, bins, len(features), number)
        _leaf_quantiles(table, states, trees, p, number)
        for s, t in zip(states, trees, strict=True):
            if t is None:
                continue
            if out_of_patience(s.losses, p.patience, p.tolerance):
                s.stopped = True  # the loss was that before this tree, which isn't kept
            elif len(t.feature) == 1 and s.quantile is None and not t.value[0]:
                s.stopped = True  # nothing is left to learn
            else:
                s.fresh.append(t)
        if all(s.stopped for s in states):
            break
        if max(len(s.fresh) for s in states) >= RESTAGE:
            table = _restaged(table, states)
    discard(table)
    return {t.name: Model(features, bounds, s.base, s.trees + s.fresh, s.losses) for t, s in zip(tasks, states, strict=True)}


def predict(df: DataFrame, models: dict[str, Model], clip_negative: bool = True) -> DataFrame:
    """``df`` with a column per model; null features count as 0.  Models of the same features share their pass through Python."""
    if not models:
        return df
    features = next(iter(models.values())).features
    if any(m.features != features for m in models.values()):
        raise ValueError("models must have the same features")
    every = list(models.values())

    @F.pandas_udf("array<double>")
    def scored(values: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.stack(values.to_list()).astype(float), nan=0.0) if len(values) else np.zeros((0, len(features)))
        out = np.stack([m.predict(x) for m in every], 1)
        return pd.Series(list(np.maximum(out, 0.0) if clip_negative else out))

    values = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    got = df.withColumn("__scores", scored(values))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in models]
    return got.select(*kept, *[F.col("__scores")[i].alias(name) for i, name in enumerate(models)])
