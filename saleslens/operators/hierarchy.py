"""Crossed hierarchy Total / Store / Family / Bottom and its reconciliation, without matrices where a closed form exists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import unique_id
from ..sources.staging import stage
from .temporal import densify

LEVELS = ("Total", "Store", "Family", "Bottom")
COHERENT = 1e-6


def create_unique_id(df: DataFrame) -> DataFrame:
    return df.withColumn("unique_id", unique_id(F.col("store_nbr"), F.col("family")))


def hierarchy_table(df: DataFrame) -> DataFrame:
    """The summing matrix as rows (level, series_id, unique_id): which bottom series a series sums."""
    ids = create_unique_id(df).select("unique_id", "store_nbr", "family").distinct()
    return ids.select(F.explode(F.array(
        F.struct(F.lit("Total").alias("level"), F.lit("Total").alias("series_id")),
        F.struct(F.lit("Store").alias("level"), F.concat(F.lit("Store_"), F.col("store_nbr").cast("string")).alias("series_id")),
        F.struct(F.lit("Family").alias("level"), F.concat(F.lit("Family_"), F.col("family")).alias("series_id")),
        F.struct(F.lit("Bottom").alias("level"), F.col("unique_id").alias("series_id")))).alias("s"), "unique_id").select("s.level", "s.series_id", "unique_id")


def get_hierarchy_levels(df: DataFrame) -> DataFrame:
    """(level, n_series)."""
    return hierarchy_table(df).groupBy("level").agg(F.count_distinct("series_id").alias("n_series"))


def aggregate_all_levels(df: DataFrame, values: list[str]) -> DataFrame:
    """(date, level, series_id, values) for every level in one pass of grouping sets."""
    names = [f"__v{i}" for i in range(len(values))]
    rows = df.select("date", "store_nbr", "family", *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])
    sets = [[F.col("date")], [F.col("date"), F.col("store_nbr")], [F.col("date"), F.col("family")], [F.col("date"), F.col("store_nbr"), F.col("family")]]
    got = rows.groupingSets(sets, F.col("date"), F.col("store_nbr"), F.col("family")).agg(
        (2 * F.grouping("store_nbr") + F.grouping("family")).alias("g"), *[F.sum(n).alias(v) for n, v in zip(names, values, strict=True)])
    level = F.when(F.col("g") == 3, "Total").when(F.col("g") == 1, "Store").when(F.col("g") == 2, "Family").otherwise("Bottom")
    name = F.when(F.col("g") == 3, "Total").when(F.col("g") == 1, F.concat(F.lit("Store_"), F.col("store_nbr").cast("string"))) \
        .when(F.col("g") == 2, F.concat(F.lit("Family_"), F.col("family"))).otherwise(unique_id(F.col("store_nbr"), F.col("family")))
    return got.select("date", level.alias("level"), name.alias("series_id"), "store_nbr", "family", *values)


def aggregate_to_level(df: DataFrame, level: str, values: list[str]) -> DataFrame:
    """One level; Bottom is passed through."""
    keys = {"Total": [], "Store": ["store_nbr"], "Family": ["family"]}
    if level not in LEVELS:
        raise ValueError(f"level: one of {LEVELS}, not {level}")
    if level == "Bottom":
        return create_unique_id(df).select("date", F.col("unique_id").alias("series_id"), *values)
    name = {"Total": F.lit("Total"), "Store": F.concat(F.lit("Store_"), F.col("store_nbr").cast("string")), "Family": F.concat(F.lit("Family_"), F.col("family"))}[level] if keys[level] or level == "Total" else None
    return df.groupBy("date", *keys[level]).agg(*[F.sum(v).alias(v) for v in values]).select("date", name.alias("series_id"), *values)


def bottom_up(df: DataFrame, pred: str = "pred") -> DataFrame:
    return aggregate_all_levels(df, [pred])


def top_down_proportions(df: DataFrame, value: str = "sales") -> DataFrame:
    """Average share of the total per series; on a date whose total is 0 all shares are 0, and the date counts."""
    total = F.sum(value).over(Window.partitionBy("date"))
    rows = df.select("date", "store_nbr", "family", (F.col(value) / F.when(total == 0, 1).otherwise(total)).alias("p"))
    return rows.groupBy("store_nbr", "family").agg(F.avg("p").alias("proportion"))


def top_down(grid: DataFrame, proportions: DataFrame, totals: DataFrame, pred: str = "pred") -> DataFrame:
    """Forecasts of the (date, store_nbr, family) rows of ``grid`` from total forecasts (date, pred): two equi-joins."""
    rows = grid.select("date", "store_nbr", "family").join(totals.select("date", F.col(pred).alias("__t")), "date").join(proportions, ["store_nbr", "family"])
    return rows.select("date", "store_nbr", "family", (F.col("__t") * F.col("proportion")).alias(pred))


class TopDown:
    """Average proportions; ``reconcile`` before ``fit`` is an error."""

    def __init__(self) -> None:
        self.proportions: DataFrame | None = None

    def fit(self, df: DataFrame, value: str = "sales") -> TopDown:
        self.proportions = top_down_proportions(df, value)
        return self

    def reconcile(self, grid: DataFrame, totals: DataFrame, pred: str = "pred") -> DataFrame:
        if self.proportions is None:
            raise ValueError("fit first")
        return top_down(grid, self.proportions, totals, pred)


def _terms(method: str) -> dict[str, Column]:
    """Coefficients of the upper levels and eigenvalues, from the numbers of stores and families on the date."""
    day = Window.partitionBy("date")
    n_s, n_f = (F.size(F.collect_set(c).over(day)).cast("double") for c in ("store_nbr", "family"))
    one = F.lit(1.0)
    if method == "ols":
        return {"__cs": one, "__cf": one, "__ct": one, "__e0": (1 + n_s) * (1 + n_f), "__es": 1 + n_f, "__ef": 1 + n_s}
    if method == "wls_struct":
        return {"__cs": 1 / n_f, "__cf": 1 / n_s, "__ct": 1 / (n_s * n_f), "__e0": F.lit(4.0), "__es": F.lit(2.0), "__ef": F.lit(2.0)}
    raise ValueError(f"method: ols or wls_struct, not {method}")


def reconcile_min_trace(df: DataFrame, method: str = "ols", total: str = "base_total", store: str = "base_store", family: str = "base_family", bottom: str = "base_bottom", out: str = "reconciled") -> DataFrame:
    """``df`` (a complete date x store x family grid whose rows carry their levels' base forecasts) with the reconciled bottom forecast.

    S'W^-1 S of a crossed grid is diagonal in the projections of a two-way analysis of variance, so with
    z = bottom + c_S store + c_F family + c_T total the answer is the mean of z, its store and family deviations and the rest, each
    divided by an eigenvalue: window averages per date, whatever the number of series.
    """
    rows = df.withColumns(_terms(method))
    rows = rows.withColumn("__z", F.col(bottom) + F.col("__cs") * F.col(store) + F.col("__cf") * F.col(family) + F.col("__ct") * F.col(total))
    m, m_s, m_f = (F.avg("__z").over(Window.partitionBy("date", *k)) for k in ((), ("store_nbr",), ("family",)))
    rows = rows.withColumns({"__m": m, "__ms": m_s, "__mf": m_f})
    m, m_s, m_f = F.col("__m"), F.col("__ms"), F.col("__mf")
    rows = rows.withColumn(out, m / F.col("__e0") + (m_s - m) / F.col("__es") + (m_f - m) / F.col("__ef") + (F.col("__z") - m_s - m_f + m))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def reconcile_forecasts(df: DataFrame, actual: str = "sales", pred: str = "pred", methods=("BottomUp", "MinTrace_ols")) -> DataFrame:
    """(date, series_id, level, actual, pred_base, pred_<method>...) from bottom forecasts; missing series of a date count as 0.

    Base forecasts of the upper levels are sums of the bottom ones, hence coherent: MinTrace then changes nothing but rounding.  For
    independent base forecasts use ``reconcile_min_trace``.
    """
    grid = densify(df.select("date", "store_nbr", "family", actual, pred), fill={actual: 0, pred: 0})
    names, columns = [], {}
    for m in methods:
        names.append(f"{pred}_{m}")
        if m == "BottomUp":
            columns[names[-1]] = None
        elif m in ("MinTrace_ols", "MinTrace_wls"):
            columns[names[-1]] = "ols" if m == "MinTrace_ols" else "wls_struct"
        else:
            raise ValueError(f"no method {m}")
    sums = {"base_total": F.sum(pred).over(Window.partitionBy("date")), "base_store": F.sum(pred).over(Window.partitionBy("date", "store_nbr")), "base_family": F.sum(pred).over(Window.partitionBy("date", "family")), "base_bottom": F.col(pred)}
    rows = grid.withColumns(sums)
    for name, method in columns.items():
        rows = rows.withColumn(name, F.col(pred)) if method is None else reconcile_min_trace(rows, method, out=name)
    out = aggregate_all_levels(rows, [actual, pred, *names])
    return out.select("date", "series_id", "level", actual, F.col(pred).alias(f"{pred}_base"), *names)


def residual_covariance(residuals: DataFrame, order: list[str], partitions: int = 64, n_dates: int | None = None) -> np.ndarray:
    """Sample covariance of the series named in ``order`` over all dates (``n_dates``, if the rows don't show them all); (date, series_id, value) rows, missing ones 0, repeated ones summed.

    Dates are vectors in at most ``partitions`` tasks, each of which adds up the products of its dates; only the rows of one n x n matrix
    reach the driver, so what it gets depends on the number of series alone.
    """
    n, place = len(order), {name: i for i, name in enumerate(order)}
    listed = F.broadcast(residuals.sparkSession.createDataFrame([(name,) for name in order], "series_id string"))
    values = residuals.join(listed, "series_id", "left_semi").groupBy("date", "series_id").agg(F.sum("value").alias("value"))
    sums = {r.series_id: r.s for r in values.groupBy("series_id").agg(F.sum("value").alias("s")).collect()}
    n_dates = residuals.select("date").distinct().count() if n_dates is None else n_dates
    mean = np.array([sums.get(name) or 0.0 for name in order]) / max(n_dates, 1)
    vectors = values.groupBy("date").agg(F.collect_list(F.struct("series_id", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("v"))

    def products(parts):
        total, seen = np.zeros((n, n)), 0
        for pdf in parts:
            for v in pdf["v"]:
                x = -mean
                for r in v:
                    if r["series_id"] in place:
                        x[place[r["series_id"]]] += r["value"]
                total += np.outer(x, x)
                seen += 1
        if seen:
            yield pd.DataFrame({"i": np.arange(n), "p": list(total), "d": seen})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "p": [np.sum(list(pdf["p"]), axis=0)], "d": [int(pdf["d"].sum())]})

    schema = "i long, p array<double>, d long"
    out, dates = np.zeros((n, n)), 0
    for r in vectors.coalesce(partitions).mapInPandas(products, schema).groupBy("i").applyInPandas(added, schema).toLocalIterator():
        out[r.i], dates = r.p, r.d
    # Dates without any of the series are vectors of zeros.
    out += (n_dates - dates) * np.outer(mean, mean)
    return out / max(n_dates - 1, 1)


#: Forecast dates whose sums are added up in one aggregate.
_DATES = 32


class _Uppers:
    """The upper series of a crossed hierarchy: total, stores, families, numbered in this order."""

    def __init__(self, base: DataFrame, most: int):
        named = base.where("level != 'Bottom'").select("series_id").distinct()
        names = [r.series_id for r in named.limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"over {most} upper series (use reconcile_min_trace)")
        self.stores = sorted(n.removeprefix("Store_") for n in names if n.startswith("Store_"))
        self.families = sorted(n.removeprefix("Family_") for n in names if n.startswith("Family_"))
        self.names = ["Total", *[f"Store_{x}" for x in self.stores], *[f"Family_{x}" for x in self.families]]
        make = base.sparkSession.createDataFrame
        self.table = F.broadcast(make(list(zip(self.names, range(len(self.names)), strict=True)), "series_id string, u int"))
        self.store_table = F.broadcast(make([(x, 1 + i) for i, x in enumerate(self.stores)], "__store string, __us int"))
        self.family_table = F.broadcast(make([(x, 1 + len(self.stores) + i) for i, x in enumerate(self.families)], "__family string, __uf int"))

    def bottoms(self, rows: DataFrame) -> DataFrame:
        """The bottom rows with the numbers of their store and family; series of others are left out."""
        store = F.substring_index("series_id", "_", 1)
        parts = rows.withColumn("__store", store).withColumn("__family", F.substring(F.col("series_id"), F.length(store) + 2, F.length("series_id")))
        return parts.join(self.store_table, "__store").join(self.family_table, "__family")

    def incoherence(self, rows: DataFrame) -> DataFrame:
        """(date, series_id, value): how far each upper series is from the sum of its bottom series."""
        up = rows.join(self.table, "series_id").select("date", "u", "value")
        down = self.bottoms(rows).select("date", F.explode(F.array(F.lit(0), "__us", "__uf")).alias("u"), (-F.col("value")).alias("value"))
        return up.unionByName(down).groupBy("date", "u").agg(F.sum("value").alias("value")).join(self.table, "u").select("date", "series_id", "u", "value")


def _matrix(rows: DataFrame, n: int) -> tuple[list, np.ndarray]:
    """Dates in order and the matrix date x upper series of (date, u, value)."""
    found = rows.groupBy("date").agg(F.collect_list(F.struct("u", "value")).alias("v")).orderBy("date").collect()
    out = np.zeros((len(found), n))
    for i, r in enumerate(found):
        for x in r.v:
            out[i, x.u] = x.value or 0.0
    return [r.date for r in found], out


def mint_shrink(base: DataFrame, residuals: DataFrame, max_series: int = 5000, shrinkage: float = 0.5) -> DataFrame:
    """MinTrace with a residual covariance drawn halfway to its diagonal: (date, store_nbr, family, reconciled), all stores by all families.

    ``base`` and ``residuals`` are long: (date, level, series_id, value), of the latter no level is needed.  With W the covariance of all series and C the constraints
    (an upper series less its bottom series), (S'W^-1 S)^-1 S'W^-1 y is y - W C'(C W C')^-1 C y.  C W C' is square in the upper series, of which there are at most
    ``max_series``; W itself is never formed: its diagonal is a variance per series, and the rest acts through the residual rows.  The driver holds C W C' and
    tables of dates by upper series; bottom series may be as many as stores by families.  Missing rows count as 0; where C W C' is singular, its pseudo-inverse is taken.
    """
    spark, up = base.sparkSession, _Uppers(base, max_series)
    n = len(up.names)
    dates = residuals.select("date").distinct().count()
    errors = stage(up.incoherence(residuals), "mint-errors")
    known = residuals.groupBy("date", "series_id").agg(F.sum("value").alias("value"))
    mean = F.sum("value") / F.lit(max(dates, 1))
    spread = F.count("value") * (F.var_pop("value") + F.pow(F.avg("value") - mean, 2)) + (F.lit(dates) - F.count("value")) * F.pow(mean, 2)
    variances = stage(known.groupBy("series_id").agg(F.coalesce(spread / F.lit(max(dates - 1, 1)), F.lit(0.0)).alias("v")), "mint-variances")

    own = up.bottoms(variances).select("__us", "__uf", "v")
    diagonal = np.zeros((n, n))
    for r in variances.join(up.table, "series_id").select("u", "v").collect():
        diagonal[r.u, r.u] += r.v
    for r in own.toLocalIterator():
        for i in (0, r["__us"], r["__uf"]):
            for j in (0, r["__us"], r["__uf"]):
                diagonal[i, j] += r.v
    w = (1 - shrinkage) * residual_covariance(errors, up.names, n_dates=dates) + shrinkage * diagonal
    asked, gaps = _matrix(up.incoherence(base), n)
    try:
        push = np.linalg.solve(w, gaps.T).T
    except np.linalg.LinAlgError:
        push = gaps @ np.linalg.pinv(w, hermitian=True)
    when, z = _matrix(errors, n)
    r = (z - z.sum(0) / max(dates, 1)) @ push.T * ((1 - shrinkage) / max(dates - 1, 1))

    blocks = range(0, len(asked), _DATES)
    pulls = [(d, b // _DATES, [float(x) for x in row[b:b + _DATES]]) for d, row in zip(when, r, strict=True) for b in blocks]
    pull = F.broadcast(spark.createDataFrame(pulls, "date date, b int, r array<double>"))
    width = min(_DATES, max(len(asked), 1))
    sums = [F.sum(F.col("value") * F.get("r", F.lit(i))).alias(f"m{i}") for i in range(width)]
    moved = up.bottoms(known).join(pull, "date").groupBy("__us", "__uf", "b").agg(*sums)
    moved = moved.select("__us", "__uf", "b", F.posexplode(F.array(*[f"m{i}" for i in range(width)])).alias("i", "moved"))
    pushes = [(d, i // _DATES, i % _DATES, [float(x) for x in row]) for i, (d, row) in enumerate(zip(asked, push, strict=True))]
    pushes = spark.createDataFrame(pushes, "date date, b int, i int, p array<double>")
    cells = pushes.select("date", "b", "i", "p", F.explode(F.lit(up.stores)).alias("__store")).join(up.store_table, "__store")
    cells = cells.withColumn("__family", F.explode(F.lit(up.families))).join(up.family_table, "__family")
    here = up.bottoms(base).groupBy("date", "__us", "__uf").agg(F.sum("value").alias("value"))
    rows = cells.join(here, ["date", "__us", "__uf"], "left").join(own, ["__us", "__uf"], "left").join(moved, ["__us", "__uf", "b", "i"], "left")
    pushed = F.get("p", F.lit(0)) + F.get("p", F.col("__us")) + F.get("p", F.col("__uf"))
    zero = F.lit(0.0)
    reconciled = F.coalesce("value", zero) + shrinkage * F.coalesce("v", zero) * pushed - F.coalesce("moved", zero)
    return rows.select("date", F.col("__store").cast("int").alias("store_nbr"), F.col("__family").alias("family"), reconciled.alias("reconciled"))


def evaluate_at_levels(df: DataFrame, actual: str = "sales", preds=("pred_base", "pred_BottomUp", "pred_MinTrace_ols")) -> DataFrame:
    """(level, method, rmsle, n_series, n_obs): both sides clipped at 0."""
    here = [p for p in preds if p in df.columns]
    long = df.select("level", "series_id", actual, F.explode(F.array(*[F.struct(F.lit(p.removeprefix("pred_")).alias("method"), F.col(p).alias("p")) for p in here])).alias("m")).select("level", "series_id", actual, "m.*")
    return long.groupBy("level", "method").agg(stats.rmsle(F.col(actual), F.col("p"), "both").alias("rmsle"), F.count_distinct("series_id").alias("n_series"), F.count("*").alias("n_obs"))


def coherence_details(df: DataFrame, pred: str) -> DataFrame:
    """Per date: the total and how far the sums of the levels are from it."""
    of = {lv: F.sum(F.when(F.col("level") == lv, F.col(pred))) for lv in LEVELS}
    out = df.groupBy("date").agg(of["Total"].alias("total"), *[F.coalesce(of[lv], F.lit(0.0)).alias(f"{lv.lower()}_sum") for lv in LEVELS[1:]]).where(F.col("total").isNotNull())
    return out.withColumns({f"{lv}_diff": F.abs(F.col("total") - F.col(f"{lv}_sum")) for lv in ("store", "family", "bottom")})


def evaluate_coherence(df: DataFrame, pred: str, atol: float = COHERENT, rtol: float = 0.0) -> DataFrame:
    """One row: whether all levels add up within ``atol`` + ``rtol`` x total on every date, and the largest differences."""
    bound = F.lit(atol) + F.lit(rtol) * F.abs("total")
    parts = ("store", "family", "bottom")
    ok = F.bool_and((F.col("store_diff") < bound) & (F.col("family_diff") < bound) & (F.col("bottom_diff") < bound))
    return coherence_details(df, pred).agg(ok.alias("is_coherent"), *[F.max(f"{p}_diff").alias(f"max_{p}_diff") for p in parts])
