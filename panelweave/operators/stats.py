"""Regression metrics, correlations, binned curves and class reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.joins import hot_keys, salted_join
from panelweave.operators.spread import average_ranks, fits, quantiles
from panelweave.operators.windows import quantile_bin
from panelweave.session import settle


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def _moments(x, y):
    """Centred second moments and means; one pass, merged stably."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return [
        F.count(F.when(both, 1)).alias("n"), F.avg(xx).alias("mx"), F.avg(yy).alias("my"),
        (F.var_pop(xx) * F.count(xx)).alias("sxx"), (F.var_pop(yy) * F.count(yy)).alias("syy"),
        (F.covar_pop(xx, yy) * F.count(xx)).alias("sxy"),
    ]


def regression_metrics(df, y, yhat, keys=()) -> DataFrame:
    """MAE, MSE and R2 = 1 - SSR / uncentred TSS of y on (1, yhat)."""
    a, b = F.col(y), F.col(yhat)
    both = a.isNotNull() & b.isNotNull()
    rows = df.where(both)
    out = rows.groupBy(*_keys(keys)).agg(
        F.avg(F.abs(a - b)).alias("MAE"), F.avg((a - b) * (a - b)).alias("MSE"),
        F.sum(a * a).alias("_tss"), *_moments(b, a))
    ssr = F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return out.select(*_keys(keys), "n", "MAE", "MSE",
                      (1 - F.try_divide(ssr, F.col("_tss"))).alias("R2"))


def ols_simple(df, x, y, keys=()) -> DataFrame:
    """Slope, intercept and the conventional standard error of the slope."""
    m = df.groupBy(*_keys(keys)).agg(*_moments(F.col(x).cast("double"), F.col(y).cast("double")))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    ssr = F.col("syy") - slope * F.col("sxy")
    return m.select(
        *_keys(keys), "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.sqrt(F.try_divide(F.try_divide(ssr, F.col("n") - 2), F.col("sxx"))).alias("se"))


def ols(df, xs, y, cov="nonrobust") -> dict:
    """Least squares with an intercept: names, coefficients, covariance, n.

    One aggregate gives the k x k cross products (k is the number of
    regressors); ``HC1`` takes a second pass for the weighted ones. Values are
    centred first, so that powers of a variable stay well conditioned.
    """
    names = list(xs)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*names, y]]).dropna()
    means = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in [*names, y]]).first()
    n, k = means["_n"], len(names) + 1
    centred = rows.select(*[(F.col(c) - F.lit(means[c])).alias(c) for c in [*names, y]])
    cols = [*names, y]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    sums = centred.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    cross = {}
    for i, (a, b) in enumerate(pairs):
        cross[a, b] = cross[b, a] = sums[i]
    gram = np.array([[cross[a, b] for b in names] for a in names])
    beta = np.linalg.solve(gram, np.array([cross[a, y] for a in names]))
    inverse = np.linalg.inv(gram)
    mean_x = np.array([means[c] for c in names])
    ssr = cross[y, y] - float(beta @ np.array([cross[a, y] for a in names]))
    if cov == "HC1":
        resid = F.col(y)
        for c, b in zip(names, beta):
            resid = resid - F.col(c) * F.lit(float(b))
        e2 = resid * resid
        full = [*names, None]
        val = lambda c: F.lit(1.0) if c is None else F.col(c)
        upper = [(i, j) for i in range(k) for j in range(i, k)]
        got = centred.agg(*[
            F.sum(e2 * val(full[i]) * val(full[j])).alias(f"m{t}") for t, (i, j) in enumerate(upper)]).first()
        meat = np.zeros((k, k))
        for t, (i, j) in enumerate(upper):
            meat[i, j] = meat[j, i] = got[t]
        bread = np.zeros((k, k))
        bread[:-1, :-1], bread[-1, -1] = inverse, 1.0 / n
        middle = bread @ meat @ bread * n / (n - k)
    else:
        middle = np.zeros((k, k))
        middle[:-1, :-1], middle[-1, -1] = inverse, 1.0 / n
        middle *= ssr / (n - k)
    # back from centred regressors: the constant shifts by -mean * beta
    shift = np.eye(k)
    shift[-1, :-1] = -mean_x
    covariance = shift @ middle @ shift.T
    const = means[y] - float(beta @ mean_x)
    return {"names": [*names, "const"], "beta": np.append(beta, const), "cov": covariance,
            "se": np.sqrt(np.diag(covariance)), "n": n, "ssr": ssr}


def ols_by(df, key, xs, y) -> dict:
    """{key: {names, beta, n}}: least squares with an intercept for every group.

    Two aggregates serve all groups: means, then centred cross products. Groups
    without enough distinct rows are left out. One row per group reaches the
    driver.
    """
    names, cols = list(xs), [*xs, y]
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    means = {r[key]: r for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols]).collect()}
    if not means:
        return {}

    def mean(c):
        chain = None
        for k, m in means.items():
            chain = (F.when if chain is None else chain.when)(F.col(key) == F.lit(k), F.lit(m[c]))
        return chain

    centred = rows.select(key, *[(F.col(c) - mean(c)).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    sums = centred.groupBy(key).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).collect()
    out = {}
    for r in sums:
        cross = {p: r[f"s{i}"] for i, (a, b) in enumerate(pairs) for p in ((a, b), (b, a))}
        gram = np.array([[cross[a, b] for b in names] for a in names])
        m = means[r[key]]
        if np.linalg.matrix_rank(gram) < len(names):
            continue
        beta = np.linalg.solve(gram, np.array([cross[a, y] for a in names]))
        const = m[y] - float(beta @ np.array([m[c] for c in names]))
        out[r[key]] = {"names": [*names, "const"], "beta": np.append(beta, const), "n": m["_n"]}
    return out


def ols_table(df, xs, y, cov="nonrobust") -> DataFrame:
    """``ols`` as rows (term, b, se); k rows."""
    fit = ols(df, xs, y, cov)
    rows = [(t, float(b), float(s)) for t, b, s in zip(fit["names"], fit["beta"], fit["se"])]
    return df.sparkSession.createDataFrame(rows, "term string, b double, se double")


def ols_predict(df, fit, out="yhat") -> DataFrame:
    value = F.lit(float(fit["beta"][-1]))
    for name, b in zip(fit["names"][:-1], fit["beta"]):
        value = value + F.col(name) * F.lit(float(b))
    return df.withColumn(out, value)


def binscatter(df, x, y, n=20, method="averaged") -> DataFrame:
    """Mean x and y per x-quantile bin."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return quantile_bin(rows, x, n, "bin", method).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"))


def within_percentiles(df, x, low=0.01, high=0.99, method="averaged") -> DataFrame:
    """Rows whose x lies above the low and up to the high percentile."""
    lo, hi = quantiles(df, x, [low, high], method)
    return df.where((F.col(x) > lo) & (F.col(x) <= hi))


def corr_pair(df, x, y, method="pearson", out="rho") -> DataFrame:
    """One correlation. Spearman is Pearson on average ranks; equal pairs are
    merged first, so repeated values cost one row."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    if method == "pearson":
        both = df.where(a.isNotNull() & b.isNotNull())
        return both.agg(F.corr(a, b).alias(out))
    pairs = settle(df.select(a.alias("_x"), b.alias("_y")).dropna()
                   .groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n")))
    # both columns are ranked in one pass, in long form
    long = pairs.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).alias("_v")) for c in ("_x", "_y")])).alias("_e")).select("_n", "_e.*")
    ranks = settle(average_ranks(long, "_v", "_v", "_r", keys="_col", weight="_n"))
    small = fits(ranks)
    joined = pairs
    for value, rank in (("_x", "_rx"), ("_y", "_ry")):
        side = ranks.where(F.col("_col") == value).select(F.col("_v").alias(value), F.col("_r").alias(rank))
        if small:
            joined = joined.join(F.broadcast(side), value)
        else:
            joined = salted_join(joined, side, value, hot=hot_keys(pairs.groupBy(value).count(), [value]))
    # ranks have the known mean (n + 1) / 2
    centre = F.broadcast(pairs.agg(((F.sum("_n") + 1) / 2).alias("_c")))
    dx, dy, w = F.col("_rx") - F.col("_c"), F.col("_ry") - F.col("_c"), F.col("_n")
    return joined.crossJoin(centre).agg(F.try_divide(
        F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy))).alias(out))


# Columns whose ranks are looked up in a broadcast table each.
MOST_LOOKUPS = 16


def rank_columns(df, cols, partition=()) -> DataFrame:
    """Average ranks of each column (within ``partition``); nulls stay null.

    All columns are ranked in one pass: unpivoted to (row, column, value) and
    ranked by column. The ranks of the distinct values, when few bytes, are
    broadcast and looked up, so no row is shuffled; else rows are joined in
    long form and pivoted back. The table is read once and stored.
    """
    cols, keys = list(cols), _keys(partition)
    rows = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    long = rows.select("_row", *keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(f"`{c}`").cast("double").alias("_v")) for c in cols])).alias("_e")).select(
        "_row", *keys, "_e._col", "_e._v").where(F.col("_v").isNotNull())
    on = [*keys, "_col", "_v"]
    ranks = average_ranks(long, "_v", "_v", "_r", keys=[*keys, "_col"])
    if len(cols) <= MOST_LOOKUPS:
        ranks = settle(ranks)
        if fits(ranks):
            out = rows
            for i, c in enumerate(cols):
                side = ranks.where(F.col("_col") == c).select(
                    *[F.col(f"`{k}`").alias(f"_k{i}_{j}") for j, k in enumerate(keys)], F.col("_v").alias(f"_v{i}"), F.col("_r").alias(f"_r{i}"))
                match = F.col(f"`{c}`").cast("double") == F.col(f"_v{i}")
                for j, k in enumerate(keys):
                    match = match & (F.col(f"`{k}`") == F.col(f"_k{i}_{j}"))
                out = out.join(F.broadcast(side), match, "left")
            rest = [c for c in df.columns if c not in cols]
            return out.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)])
    ranked = salted_join(long, ranks, on)
    wide = ranked.groupBy("_row").pivot("_col", cols).agg(F.first("_r"))
    return rows.drop(*cols).join(wide, "_row", "left").drop("_row")


def pair_sums(df, cols) -> DataFrame:
    """(i, j, n, mx, my, sxx, syy, sxy): centred second moments of every pair of
    the listed columns over the rows that have both.

    Values are centred at the column means first. A batch of rows gives the sums
    of all pairs as a few matrix products of values and masks; partial sums of
    k x k blocks are then merged by pair. The plan does not grow with the columns.
    """
    import pandas as pd

    cols, k = list(cols), len(cols)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    centre = np.array([v or 0.0 for v in rows.agg(*[F.avg(F.nanvl(f"c{i}", F.lit(None).cast("double"))) for i in range(k)]).first()])
    i, j = (np.repeat(np.arange(k), k), np.tile(np.arange(k), k))

    def run(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            x = batch.to_numpy(float) - centre
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
        yield pd.DataFrame({"i": i, "j": j, **{c: t.ravel() for c, t in zip(["n", "x", "y", "xx", "yy", "xy"], total)}})

    parts = rows.mapInPandas(run, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    mean = lambda c: F.try_divide(c, "n")
    return sums.select(
        "i", "j", F.col("n").cast("bigint").alias("n"), mean("x").alias("mx"), mean("y").alias("my"),
        (F.col("xx") - F.col("x") * mean("x")).alias("sxx"), (F.col("yy") - F.col("y") * mean("y")).alias("syy"),
        (F.col("xy") - F.col("x") * mean("y")).alias("sxy"))


def corr_matrix(df, cols, method="pearson", a="a", b="b", out="rho") -> DataFrame:
    """All pairs of the listed columns in long form.

    ``df`` is wide, one row per period, as after ``to_wide``. All pair sums are
    taken in one pass (``pair_sums``); no pairs of rows are formed.
    """
    cols = list(cols)
    rows = rank_columns(df, cols) if method == "spearman" else df
    name = lambda c: F.element_at(F.array(*[F.lit(v) for v in cols]), (F.col(c) + 1).cast("int"))
    rho = F.try_divide("sxy", F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy")))
    return pair_sums(rows, cols).select(name("i").alias(a), name("j").alias(b), rho.alias(out))


def confusion(df, y, yhat, values=None) -> DataFrame:
    """Counts per (actual, predicted); wide with the listed classes."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    if values is None:
        return counts
    return counts.groupBy("actual").pivot("predicted", list(values)).agg(
        F.sum("n")).na.fill(0)


def class_scores(df, y, yhat) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    cells = confusion(df, y, yhat)
    by_actual = cells.groupBy(F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("hit"))
    by_predicted = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    div = lambda p, q: F.coalesce(F.try_divide(p, q), F.lit(0.0))
    rows = by_actual.join(by_predicted, "class", "full_outer")
    prec, rec = div(zero("hit"), zero("said")), div(zero("hit"), zero("support"))
    return rows.select(
        "class", F.coalesce("support", F.lit(0)).alias("support"), prec.alias("precision"),
        rec.alias("recall"), div(2 * zero("hit"), zero("said") + zero("support")).alias("f1"))


def classification_report(df, y, yhat) -> DataFrame:
    """Macro F1, its largest gap between classes, accuracy, macro precision
    and recall; one row."""
    known = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    per_class = class_scores(known, y, yhat)
    return per_class.agg(
        F.avg("f1").alias("f1"), (F.max("f1") - F.min("f1")).alias("f1_gap"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("acc"),
        F.avg("precision").alias("prec"), F.avg("recall").alias("recall"))
