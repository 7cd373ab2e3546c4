"""Statistics against dense numpy computations."""

import numpy as np
import pandas as pd
import pytest

from panelweave.operators import decompose, eventstudy, stats


def test_ols(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, 200)
    y = 1 + x - 2 * x ** 3 + rng.normal(size=200) * (1 + x ** 2)
    design = np.column_stack([x, x ** 2, x ** 3, np.ones(200)])
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([design[:, :3], y]), columns=["a", "b", "c", "y"]))
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    e = y - design @ beta
    plain = np.sqrt(np.diag(inverse) * (e @ e) / 196)
    robust = np.sqrt(np.diag(inverse @ (design.T * e ** 2) @ design @ inverse) * 200 / 196)
    fit = stats.ols(df, ["a", "b", "c"], "y")
    assert np.allclose(fit["beta"], beta) and np.allclose(fit["se"], plain)
    assert np.allclose(stats.ols(df, ["a", "b", "c"], "y", "HC1")["se"], robust)


def dense_study(pdf, y, ref):
    """Dummies for every entity and distance, clustered errors."""
    pdf = pdf.dropna(subset=[y])
    pdf = pdf[pdf.groupby("e")["e"].transform("size") > 1]
    days = sorted(d for d in pdf["dist"].unique() if d != ref)
    x = np.column_stack([(pdf["dist"] == d).astype(float) for d in days])
    ents = pdf["e"].unique()
    fe = np.column_stack([(pdf["e"] == i).astype(float) for i in ents])
    full = np.column_stack([x, fe])
    v = pdf[y].to_numpy()
    beta, *_ = np.linalg.lstsq(full, v, rcond=None)
    resid = v - full @ beta
    demeaned = x - fe @ (fe.T @ x / fe.sum(0)[:, None])
    inverse = np.linalg.inv(demeaned.T @ demeaned)
    meat = sum(np.outer(s, s) for s in (demeaned[pdf["e"] == i].T @ resid[pdf["e"] == i] for i in ents))
    g, n, k = len(ents), len(v), len(days) + 1
    cov = inverse @ meat @ inverse * g / (g - 1) * (n - 1) / (n - k)
    const = v.mean() - x.mean(0) @ beta[:len(days)]
    return days, beta[:len(days)], np.sqrt(np.diag(cov)), const


def test_event_study(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(7 * w), rng.normal() + i * 0.1 + w * 0.2) for i in range(40) for w in range(-3, 4) if rng.random() < 0.6]
    pdf = pd.DataFrame(rows, columns=["e", "dist", "y"])
    pdf.loc[::11, "y"] = np.nan
    days, beta, se, const = dense_study(pdf, "y", -7)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "e int, dist int, y double")
    got = eventstudy.event_study(df, "y", "dist", "e").toPandas().set_index("dist")
    assert np.allclose(got.loc[days, "b"], beta) and np.allclose(got.loc[days, "se"], se)
    assert np.isclose(got.loc[-7, "b"], const)
    assert np.allclose(got["ul"] - got["ll"], 2 * 1.96 * got["se"])


def naive_loess(y, width, at):
    """Weighted straight lines by polyfit."""
    n, out = len(y), []
    for x0 in at:
        left = int(min(max(round(x0) - width // 2, 0), max(n - width, 0)))
        x = np.arange(left, min(left + width, n))
        gap = np.abs(x - x0)
        reach = gap.max() + max(width - n, 0) // 2
        w = np.where(gap < 0.999 * reach, (1 - (gap / reach) ** 3) ** 3, 0)
        if (w > 0).sum() == 1:
            out.append(y[x][w > 0][0])
            continue
        out.append(np.polyval(np.polyfit(x - x0, y[x], 1, w=np.sqrt(w)), 0))
    return np.array(out)


def test_seasonal_trend():
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=46)) + np.tile([1.0, -1.0], 23)
    assert np.allclose(decompose.loess(y, 7, np.arange(-1, 47)), naive_loess(y, 7, np.arange(-1, 47)))
    season, trend = np.zeros(46), np.zeros(46)
    for _ in range(5):
        cycle = np.empty(50)
        for phase in range(2):
            sub = (y - trend)[phase::2]
            cycle[phase::2] = naive_loess(sub, 7, np.arange(-1, len(sub) + 1))
        low = pd.Series(cycle).rolling(2).mean().rolling(2).mean().rolling(3).mean().dropna().to_numpy()
        season = cycle[2:48] - naive_loess(low, 3, np.arange(46))
        trend = naive_loess(y - season, 5, np.arange(46))
    got = decompose.seasonal_trend(y, 2, 7)
    assert np.allclose(got[0], season) and np.allclose(got[1], trend)


def test_detrend_is_per_series_and_checked(spark):
    rows = [(s, w, float(w % 2) + (w if s == "a" else 0)) for s in "ab" for w in range(20)]
    df = spark.createDataFrame(rows, "s string, w int, v double")
    got = decompose.detrend_residual(df, "s", "w", "v").toPandas()
    assert len(got) == 40 and got["resid"].abs().max() < 1e-8
    with pytest.raises(ValueError):
        decompose.detrend_residual(df.union(df), "s", "w", "v")


def test_correlations(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300), "b": rng.integers(0, 9, 300)})
    pdf["c"] = pdf["a"] + pdf["b"] * 0.5
    df = spark.createDataFrame(pdf)
    want = pdf.corr("spearman")
    assert np.isclose(stats.corr_pair(df, "a", "c", "spearman").first()[0], want.loc["a", "c"])
    for short in (100_000, 10):
        stats.SHORT_ROWS = short
        got = stats.corr_matrix(df, list("abc"), "spearman").toPandas().pivot(index="a", columns="b", values="rho")
        assert np.allclose(got, want)
    stats.SHORT_ROWS = 100_000


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    row = stats.classification_report(df, "y", "p").first()
    f1 = [2 / 3, 0.5, 0.0]
    assert np.isclose(row["f1"], np.mean(f1)) and np.isclose(row["f1_gap"], 2 / 3) and row["acc"] == 0.5
