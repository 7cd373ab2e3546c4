"""Entity-fixed-effect event study from sparse week counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.reshape import to_long
from panelweave.session import settle

def event_cells(df, outcomes, dist, entity) -> DataFrame:
    """Counts and sums per (outcome, entity, distance); partial sums are merged
    before the shuffle, so an entity has at most one row per distance."""
    long = to_long(
        df.select(F.col(entity).alias("entity"), F.col(dist).cast("int").alias("dist"),
                  *[F.col(c).cast("double").alias(c) for c in outcomes]),
        ["entity", "dist"], outcomes, "outcome", "y")
    return (long.where(F.col("y").isNotNull() & F.col("dist").isNotNull())
            .groupBy("outcome", "entity", "dist")
            .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s")))


def _entities(cells) -> DataFrame:
    """One row per (outcome, entity) with parallel arrays of its distances,
    counts and sums; entities seen once carry no within-variation and are left
    out."""
    rows = (cells.groupBy("outcome", "entity")
            .agg(F.sum("n").alias("n_i"), F.sum("s").alias("s_i"),
                 F.collect_list(F.struct("dist", "n", "s")).alias("cells"))
            .where("n_i > 1"))
    return rows.select("outcome", "n_i", "s_i", *[F.col(f"cells.{c}").alias(c) for c in ("dist", "n", "s")])


def _partials(entities, schema, work) -> DataFrame:
    """Per-task partial sums of k x k blocks, added up per outcome."""
    def run(batches):
        held = {}
        for pdf in batches:
            for outcome, rows in pdf.groupby("outcome"):
                block = work(outcome, rows)
                held[outcome] = held[outcome] + block if outcome in held else block
        for outcome, block in held.items():
            i, j = np.nonzero(block)
            yield pd.DataFrame({"outcome": outcome, "i": i, "j": j, "v": block[i, j]})

    return (entities.mapInPandas(run, schema).groupBy("outcome", "i", "j")
            .agg(F.sum("v").alias("v")))


def _blocks(partials, outcomes, k, width) -> dict:
    got = {o: np.zeros((k, width)) for o in outcomes}
    for o, i, j, v in partials.toPandas().itertuples(index=False):
        got[o][i, j] = v
    return got


def event_study(df, outcomes, dist, entity, ref=-7, z=1.96) -> DataFrame:
    """Effect of each event distance against ``ref`` with entity effects.

    Result rows: outcome, dist, b, se, ul, ll, n, clusters. Standard errors are
    clustered by entity with the factor G/(G-1) * (N-1)/(N-K), where K counts
    the distance dummies and the constant. The row of the reference distance
    holds the constant (mean outcome net of the effects).

    No dummy matrix is built: with c_i the week counts and s_i the week sums
    of an entity, the cross products are the sum of diag(c_i) - c_i c_i' / n_i
    and of s_i - c_i mean_i. Tasks return k x k sums; k is the number of
    distances, whatever the number of entities.
    """
    outcomes = [outcomes] if isinstance(outcomes, str) else list(outcomes)
    spark = df.sparkSession
    # read by both passes; at most entities x distances rows per outcome
    cells = settle(event_cells(df, outcomes, dist, entity))
    entities = _entities(cells)
    days = [r[0] for r in cells.select("dist").distinct().orderBy("dist").collect()]
    if ref not in days:
        raise ValueError(f"reference distance {ref} not present")
    grid = np.array(days)
    k, r = len(days), days.index(ref)
    schema = "outcome string, i int, j int, v double"

    def dense(rows):
        row = np.repeat(np.arange(len(rows)), rows["dist"].str.len())
        col = np.searchsorted(grid, np.concatenate(rows["dist"].to_numpy()))
        c, s = np.zeros((len(rows), k)), np.zeros((len(rows), k))
        c[row, col] = np.concatenate(rows["n"].to_numpy())
        s[row, col] = np.concatenate(rows["s"].to_numpy())
        return c, s, rows["n_i"].to_numpy()[:, None], rows["s_i"].to_numpy()[:, None]

    def gram(_, rows):
        # columns: k x k cross products, cross product with y, counts, sums,
        # and in the last column the numbers of rows and entities
        c, s, n, t = dense(rows)
        out = np.zeros((k, k + 4))
        out[:, :k] = np.diag(c.sum(0)) - (c / n).T @ c
        out[:, k] = (s - c * (t / n)).sum(0)
        out[:, k + 1], out[:, k + 2] = c.sum(0), s.sum(0)
        out[0, k + 3] = len(rows)
        return out

    got = _blocks(_partials(entities, schema, gram), outcomes, k, k + 4)
    free = np.array([i for i in range(k) if i != r])
    fits = {}
    for o in outcomes:
        full = got[o]
        n, g = full[:, k + 1].sum(), full[0, k + 3]
        if n == 0:
            continue
        inverse = np.linalg.pinv(full[np.ix_(free, free)])
        beta = np.zeros(k)
        beta[free] = inverse @ full[free, k]
        mean_x = full[:, k + 1] / n
        const = full[:, k + 2].sum() / n - mean_x @ beta
        fits[o] = (beta, inverse, mean_x, const, n, g)

    def meat(outcome, rows):
        if outcome not in fits:
            return np.zeros((k, k))
        beta = fits[outcome][0]
        c, s, n, t = dense(rows)
        u = s - c * (t / n) - c * (beta - (c @ beta)[:, None] / n)
        return u.T @ u

    middles = _blocks(_partials(entities, schema, meat), outcomes, k, k)
    rows = []
    for o, (beta, inverse, mean_x, const, n, g) in fits.items():
        factor = g / (g - 1) * (n - 1) / (n - len(free) - 1)
        cov = inverse @ middles[o][np.ix_(free, free)] @ inverse * factor
        se = np.zeros(k)
        se[free] = np.sqrt(np.maximum(np.diag(cov), 0))
        m = mean_x[free]
        values = beta.copy()
        values[r], se[r] = const, float(np.sqrt(max(m @ cov @ m, 0)))
        rows += [(o, int(d), float(b), float(e), float(b + z * e), float(b - z * e), int(n), int(g))
                 for d, b, e in zip(days, values, se)]
    return spark.createDataFrame(
        rows, "outcome string, dist int, b double, se double, ul double, ll double, "
              "n bigint, clusters bigint")


def event_wide(study, outcomes, index="dist") -> DataFrame:
    """One row per distance with b/se/ul/ll columns per outcome."""
    wide = study.groupBy(index).pivot("outcome", list(outcomes)).agg(
        *[F.first(c).alias(c) for c in ("b", "se", "ul", "ll")])
    return wide.select(index, *[
        F.col(f"{o}_{c}").alias(f"{c}{o}") for o in outcomes for c in ("b", "se", "ul", "ll")])
