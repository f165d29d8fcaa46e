"""Seasonal-trend decomposition by LOESS (Cleveland et al. 1990), one series per task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .eda import daily_totals, top_families
from .temporal import regularize


def loess(y: np.ndarray, q: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear fits with tricube weights over the ``q`` nearest of equally spaced points, evaluated at positions ``at``."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, dtype=float)
    k = min(q, n)
    start = np.clip(np.round(at).astype(int) - k // 2, 0, n - k)
    idx = start[:, None] + np.arange(k)[None]
    dist = np.abs(idx - at[:, None])
    reach = dist.max(axis=1, keepdims=True) + max(0, (q - n) // 2)
    w = (1 - np.clip(dist / np.maximum(reach * 1.001, 1e-9), 0, 1) ** 3) ** 3
    if weights is not None:
        w = w * weights[idx]
    total = w.sum(axis=1, keepdims=True)
    w = np.divide(w, total, out=np.full_like(w, 1 / k), where=total > 1e-12)
    x = idx - at[:, None]
    mean_x = (w * x).sum(axis=1, keepdims=True)
    mean_y = (w * y[idx]).sum(axis=1)
    spread = (w * (x - mean_x) ** 2).sum(axis=1)
    slope = np.divide((w * (x - mean_x) * y[idx]).sum(axis=1), spread, out=np.zeros(len(at)), where=spread > 1e-9)
    return mean_y - slope * mean_x[:, 0]


def moving_average(x: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(np.r_[0.0, x])
    return (c[n:] - c[:-n]) / n


def _odd(n: int) -> int:
    return n if n % 2 else n + 1


def decompose(y: np.ndarray, period: int = 7, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, residual); ``outer`` passes reweight outlying points (0: not robust)."""
    n = len(y)
    trend_q = _odd(int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))))
    low_q = _odd(period + 1)
    season, trend, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                part = (y - trend)[k::period]
                cycle[k::period][:len(part) + 2] = loess(part, seasonal, robust[k::period], np.arange(-1, len(part) + 1))
            low = loess(moving_average(moving_average(moving_average(cycle, period), period), 3), low_q)
            season = cycle[period:period + n] - low
            trend = loess(y - season, trend_q, robust)
        if turn < outer:
            off = np.abs(y - season - trend)
            h = 6 * np.median(off)
            robust = np.where(off <= 0.001 * h, 1.0, (1 - np.clip(off / max(h, 1e-12), 0, 1) ** 2) ** 2)
    return season, trend, y - season - trend


def strengths(y: np.ndarray, period: int = 7) -> dict[str, float]:
    """Trend and seasonal strength, 1 - var(residual) / var(component + residual), and the residual's deviation."""
    s, t, r = decompose(y, period)
    var = [np.var(x, ddof=1) for x in (r, t + r, s + r)]
    return {"trend_strength": 1 - var[0] / var[1] if var[1] else float("nan"), "seasonal_strength": 1 - var[0] / var[2] if var[2] else float("nan"), "residual_std": float(np.std(r, ddof=1))}


def perform_stl_decomposition(df: DataFrame, families: list[str] | None = None, n_families: int = 4, period: int = 7, min_points: int = 14) -> DataFrame:
    """(family, trend_strength, seasonal_strength, residual_std) of the daily totals of ``families``, or of the best-selling ones.

    Totals are summed by Spark and made daily; each family's series, one value per day, is decomposed in a task of its own.
    Series of fewer than ``min_points`` days are left out.
    """
    if families is None:
        families = [r.family for r in top_families(df, n_families).collect()]
    daily = regularize(daily_totals(df.where(df["family"].isin(families)), "family"), "sales", ["family"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["family", "trend_strength", "seasonal_strength", "residual_std"]
        if len(pdf) < min_points:
            return pd.DataFrame(columns=columns)
        y = pdf.sort_values("date")["sales"].to_numpy(float)
        return pd.DataFrame([{"family": pdf["family"].iloc[0]} | strengths(y, period)])[columns]

    return daily.groupBy("family").applyInPandas(one, "family string, trend_strength double, seasonal_strength double, residual_std double")
