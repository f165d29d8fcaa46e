"""Ordered operators over time series: all windows over one series share a single exchange and sort.

A series is a group of ``keys``; the window functions never cross series unless ``across=True``, which reproduces the
behaviour of rolling over one global order, dealt out in ranges of it.  Exponential means of series too long for one window
are put together from chunks of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

KEYS = ("store_nbr", "family")
UNBOUNDED, CURRENT, END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing
#: Longest series for which the exponential prefix sums stay finite, by span (the exponent is centred).
_MAX_LOG = 700.0


def series(keys=KEYS, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def add_lags(df: DataFrame, column: str, lags, keys=KEYS, order: str = "date", prefix: str | None = None) -> DataFrame:
    """Value ``k`` rows before, as ``{prefix}_lag_{k}``; null where there is none."""
    w = series(keys, order)
    return df.withColumns({f"{prefix or column}_lag_{k}": F.lag(column, k).over(w) for k in lags})


_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(expr: Column, stat: str, rows: int, keys=KEYS, order: str = "date", lagged: bool = True, full: bool = False) -> Column:
    """``stat`` of the last ``rows`` rows; ``lagged`` ends at the row before.  ``full``: null unless the frame is full."""
    w = series(keys, order).rowsBetween(-rows, -1) if lagged else series(keys, order).rowsBetween(1 - rows, 0)
    out = _STATS[stat](expr).over(w)
    return F.when(F.count(expr).over(w) == rows, out) if full else out


def add_rolling(df: DataFrame, column: str, windows, keys=KEYS, order: str = "date", stats=("mean", "std", "min", "max"), across: bool = False) -> DataFrame:
    """``{column}_rolling_{stat}_{n}`` of the ``n`` rows before each row."""
    if not across:
        return df.withColumns({f"{column}_rolling_{s}_{n}": rolling(F.col(column), s, n, keys, order) for n in windows for s in stats})
    return _rolled_across(df, column, windows, keys, order, stats)


def pieced(df: DataFrame, keys, order: str) -> DataFrame:
    """``df`` staged with ``__piece``: ranges of the global order (keys, order), of like size, each in one partition."""
    columns = [*keys, order]
    return stage(df.repartitionByRange(*columns).withColumn("__piece", F.spark_partition_id().cast("long")), "pieces")


def _rolled_across(df: DataFrame, column: str, windows, keys, order: str, stats) -> DataFrame:
    """Rolling over the global order of all series: every piece gets the last rows of those before it, as many as a window reaches back.

    The number of rows of each piece, a row a partition, is collected.
    """
    rows = pieced(df, keys, order)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("__piece").count().collect())
    starts = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    reach = max(windows)
    inside = Window.partitionBy("__piece").orderBy(*keys, order)
    if not starts:
        starts = [(0, 0)]
    place = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(a).cast("long").alias("a")) for p, a in starts])
    start = F.element_at(F.filter(place, lambda x: x["p"] == F.col("__piece")), 1)["a"]
    rows = rows.withColumn("__at", start + F.row_number().over(inside) - 1)
    later = F.filter(place, lambda x: (x["p"] > F.col("__piece")) & (x["a"] <= F.col("__at") + reach))
    ends = F.create_map(*[F.lit(x) for (p, a), (_, n) in zip(starts, sizes or [(0, 0)], strict=True) for x in (p, a + n)])
    halo = rows.where(ends[F.col("__piece").cast("int")] - F.col("__at") <= reach).withColumn("__to", F.explode(F.transform(later, lambda x: x["p"])))
    every = rows.withColumn("__own", F.lit(True)).unionByName(halo.drop("__piece").withColumnRenamed("__to", "__piece").withColumn("__own", F.lit(False)))
    line = Window.partitionBy("__piece").orderBy("__at")
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(k, 1).over(line).eqNullSafe(F.col(k)) & (F.lag(F.lit(1), 1).over(line) == 1)
    every = every.withColumn("__before", F.when(same, F.lag(column, 1).over(line)))
    out = every.withColumns({f"{column}_rolling_{s}_{n}": _STATS[s]("__before").over(line.rowsBetween(1 - n, 0)) for n in windows for s in stats})
    return out.where("__own").drop("__before", "__own", "__at", "__piece")


def _longest(span: int) -> int:
    """Rows of a series for which b^-i, the exponent centred, stays finite."""
    return int(2 * _MAX_LOG / -math.log(1 - 2 / (span + 1)))


def ewm_weight(column: str, span: int, keys=KEYS, order: str = "date") -> Column:
    """b^-i with b = 1 - 2/(span+1), the exponent centred on the series; for series of at most ``_longest`` rows."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(F.col(column).isNotNull(), F.pow(F.lit(1 - 2 / (span + 1)), n / 2 - F.row_number().over(series(keys, order))))


def add_ewm(df: DataFrame, column: str, spans, keys=KEYS, order: str = "date", rows: int | None = None) -> DataFrame:
    """``{column}_ewm_{span}``: exponentially weighted mean of the rows before, weights b^age, nulls skipped.

    The ratio of the prefix sums of x * b^-i and of b^-i; where the longest series has too many ``rows`` for that (counted, if not
    given), ``add_ewm_long``.
    """
    if rows is None:
        rows = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if rows > min(map(_longest, spans)):
        return add_ewm_long(df, column, spans, keys, order)
    before = series(keys, order).rowsBetween(UNBOUNDED, -1)
    df = df.withColumns({f"__w{s}": ewm_weight(column, s, keys, order) for s in spans})
    df = df.withColumns({f"{column}_ewm_{s}": F.try_divide(F.sum(F.col(column) * F.col(f"__w{s}")).over(before), F.sum(f"__w{s}").over(before)) for s in spans})
    return df.drop(*[f"__w{s}" for s in spans])


#: Rows of a chunk of a long series: 3^256, the largest weight (of a span of 2), is a finite double.
_CHUNK = 256


def _aged(b: Column):
    """A chunk's state when the chunk that starts at ``__start`` begins."""
    return lambda y: F.struct((y["n"] * F.pow(b, F.col("__start") - y["e"])).alias("n"), (y["d"] * F.pow(b, F.col("__start") - y["e"])).alias("d"))


def add_ewm_long(df: DataFrame, column: str, spans, keys=KEYS, order: str = "date") -> DataFrame:
    """As ``add_ewm`` for series of any length, whose rows are never in one task; spans from 2.

    Ranges of the order are cut into chunks.  A chunk's state (sums of x * b^age and of b^age at its last row) follows from its own rows; the state
    before it is the sum of earlier chunks' states, each times b to the rows since: a linear recurrence, of which only chunks within reach count
    (b^rows above the smallest double); where that many rows before are null, the mean is null.
    """
    rows, place, zero = pieced(df, keys, order), ["__piece", "__chunk"], F.lit(0.0)
    nth = F.row_number().over(Window.partitionBy(*keys, "__piece").orderBy(order)) - 1
    rows = rows.withColumn("__nth", nth).withColumn("__chunk", F.floor(F.col("__nth") / _CHUNK)).withColumn("__i", F.col("__nth") % _CHUNK).drop("__nth")
    x = F.col(column).cast("double")
    inside = Window.partitionBy(*keys, *place).orderBy("__i").rowsBetween(UNBOUNDED, -1)
    base = {s: F.lit(1 - 2 / (s + 1)) for s in spans}
    weighted = {}
    for s, b in base.items():
        w = F.when(x.isNotNull(), F.pow(b, -F.col("__i")))
        weighted |= {f"__n{s}": x * w, f"__d{s}": w}
    own = {c: F.coalesce(F.sum(v).over(inside), zero) * F.pow(base[int(c[3:])], F.col("__i") - 1) for c, v in weighted.items()}
    states = [(F.coalesce(F.sum(v), zero) * F.pow(base[int(c[3:])], F.count("*") - 1)).alias(c) for c, v in weighted.items()]

    totals = rows.groupBy(*keys, *place).agg(F.count("*").alias("__rows"), *states)
    totals = totals.withColumn("__end", F.sum("__rows").over(Window.partitionBy(*keys).orderBy(*place))).withColumn("__start", F.col("__end") - F.col("__rows"))
    carried = []
    for s, b in base.items():
        reach = math.ceil(745 / -math.log(1 - 2 / (s + 1))) + _CHUNK
        earlier = Window.partitionBy(*keys).orderBy("__start").rangeBetween(-reach, -1)
        seen = F.collect_list(F.struct(F.col(f"__n{s}").alias("n"), F.col(f"__d{s}").alias("d"), F.col("__end").alias("e"))).over(earlier)
        now = F.transform(seen, _aged(b))
        carried += [F.aggregate(F.transform(now, lambda y: y["n"]), zero, lambda a, v: a + v).alias(f"__n{s}c"), F.aggregate(F.transform(now, lambda y: y["d"]), zero, lambda a, v: a + v).alias(f"__d{s}c")]
    carry = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"{c}c") for c in place], *carried)
    same = (F.col("__piece") == F.col("__piecec")) & (F.col("__chunk") == F.col("__chunkc"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.withColumns(own).join(carry, same)
    out = {}
    for s, b in base.items():
        n, d = (F.col(f"__{k}{s}") + F.pow(b, F.col("__i")) * F.col(f"__{k}{s}c") for k in "nd")
        out[f"{column}_ewm_{s}"] = F.when(d > 0, F.try_divide(n, d))
    return rows.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *out)


def fill_both_ways(column: str, window) -> Column:
    """Last value so far, or else the next one."""
    return F.coalesce(F.last(column, ignorenulls=True).over(window.rowsBetween(UNBOUNDED, 0)), F.first(column, ignorenulls=True).over(window.rowsBetween(0, END)))


def cumulative(expr: Column, keys=KEYS, order: str = "date") -> Column:
    return F.sum(expr).over(series(keys, order).rowsBetween(UNBOUNDED, 0))


def add_zero_streak(df: DataFrame, column: str = "sales", out: str = "zero_streak", keys=KEYS, order: str = "date") -> DataFrame:
    """Consecutive zero rows up to each row: rows since the last non-zero one (gaps and islands)."""
    return (df.withColumn("__island", cumulative((F.col(column) != 0).cast("int"), keys, order))
            .withColumn(out, F.sum((F.col(column) == 0).cast("int")).over(Window.partitionBy(*keys, "__island").orderBy(order).rowsBetween(UNBOUNDED, 0))).drop("__island"))


def add_first_positive_age(df: DataFrame, column: str = "sales", keys=KEYS, order: str = "date", new_days: int = 30) -> DataFrame:
    """Days since the first positive value (0 before it and for series without one) and whether that is at most ``new_days``."""
    first = F.min(F.when(F.col(column) > 0, F.col(order))).over(Window.partitionBy(*keys))
    age = F.coalesce(F.greatest(F.datediff(F.col(order), first), F.lit(0)), F.lit(0))
    return df.withColumn("days_since_first_sale", age).withColumn("is_new_series", (F.col("days_since_first_sale") <= new_days).cast("int"))


def densify(df: DataFrame, keys=KEYS, order: str = "date", fill: dict | None = None, calendar: str = "observed") -> DataFrame:
    """Every key with every date; ``calendar``: ``observed`` dates of any key, or ``daily`` from the first to the last.

    The dates, one array that the calendar bounds, come from a scalar subquery and are exploded per key, so nothing is crossed or collected.
    """
    if calendar == "observed":
        days = df.select(order).distinct().agg(F.sort_array(F.collect_list(order)))
    else:
        days = df.agg(F.sequence(F.min(order).cast("date"), F.max(order).cast("date")))
    grid = df.select(*keys).distinct().withColumn("__days", days.scalar()).select(*keys, F.explode("__days").alias(order))
    return grid.join(df, [*keys, order], "left").fillna(fill or {})


def regularize(df: DataFrame, value: str, keys=(), order: str = "date") -> DataFrame:
    """Daily rows per key, missing ones filled forward, then 0."""
    ends = df.groupBy(*keys).agg(F.min(order).alias("__a"), F.max(order).alias("__b"))
    grid = ends.select(*keys, F.explode(F.sequence("__a", "__b")).alias(order))
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(1)).orderBy(order)
    return grid.join(df, [*keys, order], "left").withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(UNBOUNDED, 0)), F.lit(0.0)))


def asof_join(left: DataFrame, right: DataFrame, on: str, by=(), direction: str = "backward", values=()) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row at or before ``on`` (``forward``: the first at or after) of the same ``by``.

    Both sides are put into one ordered stream per key, so the join costs one shuffle and no pairs are made.
    """
    values = list(values) or [c for c in right.columns if c != on and c not in by]
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    kind = F.lit(1 if direction == "backward" else 0)
    a = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("__row"), *by, on, F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType).alias("__value"), kind.alias("__side"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *by, on, packed.alias("__value"), (1 - kind).alias("__side"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    if direction == "backward":
        got = F.last("__value", ignorenulls=True).over(w.orderBy(on, "__side").rowsBetween(UNBOUNDED, 0))
    else:
        got = F.first("__value", ignorenulls=True).over(w.orderBy(on, "__side").rowsBetween(0, END))
    return (a.unionByName(b).withColumn("__got", got).where(F.col("__row").isNotNull())
            .select("__row.*", *[F.col(f"__got.{v}").alias(v) for v in values]))


def event_distances(dates: DataFrame, is_event: Column, order: str = "date", cap: int | None = 30) -> DataFrame:
    """Per date: days to the next and since the last event among ``dates``, at most ``cap``, which also stands for none."""
    w = Window.partitionBy(F.lit(1)).orderBy(order)  # one row per date
    event = F.when(is_event, F.col(order))
    to = F.datediff(F.min(event).over(w.rowsBetween(0, END)), F.col(order))
    since = F.datediff(F.col(order), F.max(event).over(w.rowsBetween(UNBOUNDED, 0)))
    if cap is not None:
        to, since = (F.coalesce(F.least(x, F.lit(cap)), F.lit(cap)) for x in (to, since))
    return dates.withColumns({"days_to_holiday": to, "days_since_holiday": since})


def rolling_corr(a: str, b: str, rows: int, window) -> Column:
    """Pearson correlation of the last ``rows`` rows; null unless the frame is full and both columns vary in it."""
    w = window.rowsBetween(1 - rows, 0)
    return F.when(F.count("*").over(w) == rows, F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)))
