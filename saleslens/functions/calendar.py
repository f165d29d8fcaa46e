"""Calendar columns of a date.  Weekdays count from Monday = 0, weeks are ISO weeks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(d: Column) -> dict[str, Column]:
    """Name -> column for every plain calendar feature of the date ``d``."""
    day, dim, doy = F.dayofmonth(d), F.dayofmonth(F.last_day(d)), F.dayofyear(d)
    return {
        "year": F.year(d), "month": F.month(d), "day": day, "dayofweek": F.weekday(d), "dayofyear": doy,
        "weekofyear": F.weekofyear(d), "quarter": F.quarter(d), "is_weekend": F.weekday(d) >= 5,
        "is_month_start": day == 1, "is_month_end": d == F.last_day(d), "days_in_month": dim,
        "day_of_month_sin": wave(F.sin, day, dim), "day_of_month_cos": wave(F.cos, day, dim),
        "is_payday": (day == 15) | (d == F.last_day(d)), "days_to_payday": F.least(F.abs(day - 15), dim - day, day),
        "days_since_month_start": day - 1, "days_to_month_end": dim - day, "year_progress": doy / F.lit(365.25),
    }


def master_calendar_columns(d: Column) -> dict[str, Column]:
    """The calendar columns that a master panel carries."""
    names = ("year", "month", "day", "dayofweek", "dayofyear", "weekofyear", "is_weekend", "is_month_start", "is_month_end")
    every = calendar_columns(d)
    return {n: every[n] for n in names}


def wave(f, x: Column, period, harmonic: int = 1) -> Column:
    """``f`` (sin or cos) of x on a circle of ``period``."""
    return f(F.lit(2 * math.pi * harmonic) * x / (F.lit(float(period)) if isinstance(period, int | float) else period))


def cyclical_columns(dow: Column, month: Column, doy: Column, week: Column) -> dict[str, Column]:
    out = {}
    for name, x, period in (("dow", dow, 7), ("month", month, 12), ("doy", doy, 365.25), ("woy", week, 52)):
        out[f"{name}_sin"], out[f"{name}_cos"] = wave(F.sin, x, period), wave(F.cos, x, period)
    return out


def fourier_columns(dow: Column, doy: Column, periods: list[tuple[int, int]]) -> dict[str, Column]:
    """Harmonics: a period of 7 runs over the weekday, any other over the day of the year."""
    out = {}
    for period, harmonics in periods:
        t = dow if period == 7 else doy
        for k in range(1, harmonics + 1):
            out[f"fourier_sin_{period}_{k}"], out[f"fourier_cos_{period}_{k}"] = wave(F.sin, t, period, k), wave(F.cos, t, period, k)
    return out


def event_columns(d: Column, event: str, aftermath: int = 14, recovery: int = 56) -> tuple[Column, Column, Column]:
    """Days since ``event`` (0 before), whether within ``aftermath`` days from it, and whether after that within ``recovery``."""
    since = F.datediff(d, F.lit(event).cast("date"))
    return F.greatest(since, F.lit(0)), since.between(0, aftermath).cast("int"), ((since > aftermath) & (since <= recovery)).cast("int")


WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def weekday_label(dow: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), dow + 1)
