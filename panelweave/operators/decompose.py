"""Detrending of many weekly series.

A series holds one value per week, so its length is the number of weeks; that
is checked before a series is handed to one task. Not meant for rows that are
not one per period.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave import fixed
from panelweave.operators.quality import assert_unique


def loess(y, width, at=None):
    """Local linear fit with tricube weights on an even grid.

    ``at`` lists the positions to fit (the grid by default; positions outside
    extrapolate from the nearest window).
    """
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, dtype=float)
    grid = np.arange(n, dtype=float)
    q = min(width, n)
    fit = np.empty(len(at))
    for t, x0 in enumerate(at):
        left = int(min(max(round(x0) - width // 2, 0), n - q))
        x, v = grid[left:left + q], y[left:left + q]
        gap = np.abs(x - x0)
        reach = gap.max() + (width - n) // 2 if width > n else gap.max()
        w = np.where(gap <= 0.999 * reach,
                     np.where(gap <= 0.001 * reach, 1.0, (1 - (gap / max(reach, 1e-300)) ** 3) ** 3), 0.0)
        w /= w.sum()
        mean = (w * x).sum()
        spread = (w * (x - mean) ** 2).sum()
        if np.sqrt(spread) > 0.001 * (n - 1):
            w = w * (1 + (x0 - mean) * (x - mean) / spread)
        fit[t] = (w * v).sum()
    return fit


def _average(y, n):
    return np.convolve(y, np.ones(n) / n, "valid")


def seasonal_trend(y, period=fixed.STL_PERIOD, seasonal=fixed.STL_SEASONAL, rounds=5):
    """Seasonal and trend part by repeated local fits (Cleveland et al. 1990)."""
    n = len(y)
    trend_width = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_width += trend_width % 2 == 0
    low_width = period + 1 + period % 2
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        cycle = np.empty(n + 2 * period)
        flat = y - trend
        for phase in range(period):
            sub = flat[phase::period]
            cycle[phase::period] = loess(sub, seasonal, np.arange(-1, len(sub) + 1))
        low = _average(_average(_average(cycle, period), period), 3)
        season = cycle[period:period + n] - loess(low, low_width)
        trend = loess(y - season, trend_width)
    return season, trend


def _check(df, series, week):
    assert_unique(df, [series, week])


def detrend_residual(df, series, week, value, period=fixed.STL_PERIOD,
                     seasonal=fixed.STL_SEASONAL, out="resid") -> DataFrame:
    """Residual of the seasonal-trend decomposition, series by series.

    ``df`` is long and unique on (series, week). Series run in parallel.
    """
    _check(df, series, week)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        y = pdf["value"].to_numpy(float)
        season, trend = seasonal_trend(y, period, seasonal)
        return pd.DataFrame({"series": pdf["series"], "week": pdf["week"], "resid": y - season - trend})

    rows = df.select(F.col(series).alias("series"), F.col(week).alias("week"),
                     F.col(value).cast("double").alias("value"))
    done = rows.groupBy("series").applyInPandas(
        run, f"series {kinds[series]}, week {kinds[week]}, resid double")
    return done.toDF(series, week, out)


def detrend_moving(df, series, week, value, period=fixed.STL_PERIOD,
                   seasonal=fixed.STL_SEASONAL, out="resid") -> DataFrame:
    """The same idea with plain windows: subtract a centred moving mean of
    ``seasonal`` weeks, then the mean of each phase of the period."""
    half = seasonal // 2
    w = Window.partitionBy(series).orderBy(week)
    around = w.rowsBetween(-half, half)
    rows = (df.withColumn("_flat", F.col(value).cast("double") - F.avg(value).over(around))
            .withColumn("_phase", (F.row_number().over(w) - 1) % period))
    phase = Window.partitionBy(series, "_phase")
    return rows.select(series, week, (F.col("_flat") - F.avg("_flat").over(phase)).alias(out))
