"""Decomposition against plain loops over points."""

from datetime import date, timedelta

import numpy as np
import pytest

from saleslens.operators import stl


def plain_loess(y, q, weights, at):
    """One weighted least-squares line per point."""
    n, out = len(y), []
    for x0 in at:
        k = min(q, n)
        first = min(max(int(round(x0)) - k // 2, 0), n - k)
        xs = list(range(first, first + k))
        reach = max(abs(x - x0) for x in xs) + max(0, (q - n) // 2)
        w = [weights[x] * (1 - min(abs(x - x0) / max(reach * 1.001, 1e-9), 1) ** 3) ** 3 for x in xs]
        if sum(w) <= 1e-12:
            w = [1.0] * k
        root = np.sqrt(w)
        design = np.stack([np.ones(k), np.array(xs) - x0], 1)
        out.append(np.linalg.lstsq(design * root[:, None], np.array([y[x] for x in xs]) * root, rcond=None)[0][0])
    return np.array(out)


def average(x, n):
    return np.array([np.mean(x[i:i + n]) for i in range(len(x) - n + 1)])


def plain_stl(y, period=7, seasonal=7, inner=2, outer=15):
    n, ones = len(y), np.ones(len(y))
    trend_q = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_q += trend_q % 2 == 0
    low_q = period + 1 + (period % 2)
    season, trend, robust = np.zeros(n), np.zeros(n), ones
    for turn in range(outer + 1):
        for _ in range(inner):
            free, cycle = y - trend, np.zeros(n + 2 * period)
            for k in range(period):
                part = free[k::period]
                smooth = plain_loess(part, seasonal, robust[k::period], range(-1, len(part) + 1))
                for j, v in enumerate(smooth):
                    cycle[k + j * period] = v
            smooth = average(average(average(cycle, period), period), 3)
            season = cycle[period:period + n] - plain_loess(smooth, low_q, np.ones(len(smooth)), range(len(smooth)))
            trend = plain_loess(y - season, trend_q, robust, range(n))
        if turn < outer:
            off = np.abs(y - season - trend)
            h = 6 * np.median(off)
            robust = np.array([1.0 if o <= 0.001 * h else (1 - min(o / max(h, 1e-12), 1) ** 2) ** 2 for o in off])
    return season, trend, y - season - trend


@pytest.mark.parametrize(("n", "outer"), [(70, 0), (61, 3), (100, 15)])
def test_components_are_those_of_plain_loops(n, outer):
    rng = np.random.default_rng(n)
    y = 10 + np.arange(n) / 9 + 4 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(size=n)
    y[n // 2] += 40
    for a, b in zip(stl.decompose(y, outer=outer), plain_stl(y, outer=outer), strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_strengths_of_families(spark):
    """Gaps are filled forward, short series are left out."""
    rng, first = np.random.default_rng(2), date(2020, 1, 1)
    series = {"A": 20 + 5 * np.sin(np.arange(60) * 2 * np.pi / 7) + rng.normal(size=60), "B": 50 + rng.normal(size=40), "C": np.arange(9.0)}
    rows = [(first + timedelta(days=i), s, f, float(v) / 2) for f, y in series.items() for i, v in enumerate(y) for s in (1, 2) if not (f == "A" and i == 30)]
    got = {r.family: r for r in stl.perform_stl_decomposition(spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double")).collect()}
    assert set(got) == {"A", "B"}
    for f in got:
        y = series[f].copy()
        if f == "A":
            y[30] = y[29]
        season, trend, rest = plain_stl(y)
        want = (1 - np.var(rest, ddof=1) / np.var(trend + rest, ddof=1), 1 - np.var(rest, ddof=1) / np.var(season + rest, ddof=1), np.std(rest, ddof=1))
        assert (got[f].trend_strength, got[f].seasonal_strength, got[f].residual_std) == pytest.approx(want, abs=1e-7)
