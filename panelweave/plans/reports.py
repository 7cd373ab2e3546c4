"""Correlation networks, topic series, event studies, curves and model tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave import fixed
from panelweave.functions import text as textfn
from panelweave.operators import (
    aggregates, decompose, eventstudy, features, filters, graph, joins, models, ordering, reshape, stats, topics, windows,
)
from panelweave.operators.spread import quantiles_many
from panelweave.session import drop_scratch, settle, store


def weekly_series(panel, tags, bins, groups, week="week_start", bin_col="score_bin", value=None) -> DataFrame:
    """Long (series, week, value): rows (or the sum of ``value``) per bin, and
    tag counts per group."""
    agg = F.count(F.lit(1)) if value is None else F.sum(value)
    by_bin = (panel.where(F.col(bin_col).isin(list(bins)))
              .groupBy(F.col(bin_col).alias("series"), week).agg(agg.cast("double").alias("value")))
    if tags is None:
        return by_bin
    weekly = aggregates.group_sums(tags, week, list(groups))
    by_tag = reshape.to_long(weekly, [week], groups, "series", "value").select(
        "series", week, F.col("value").cast("double").alias("value"))
    return by_bin.unionByName(by_tag)


def activity_correlation(series, names, week="week_start", method="spearman", detrend="loess",
                         period=fixed.STL_PERIOD, seasonal=fixed.STL_SEASONAL) -> DataFrame:
    """Correlation matrix of the detrended weekly series, in long form."""
    step = decompose.detrend_residual if detrend == "loess" else decompose.detrend_moving
    resid = step(series, "series", week, "value", period, seasonal)
    wide = reshape.to_wide(resid, week, "series", names, "resid")
    return stats.corr_matrix(wide, names, method)


def correlation_network(corr, threshold=fixed.CORR_THRESHOLD) -> DataFrame:
    return graph.threshold_network(corr, threshold)


def topic_share_series(assigned, groups, week="week_start", topic="pred", prefix="topic_", drop="Other",
                       n=3) -> DataFrame:
    """Weekly share of each topic group, smoothed.

    Shares include the dropped group; weeks that hold only that group are
    absent from the balanced panel, and the mean runs over panel rows.
    """
    rows = filters.assign_cases(
        assigned, "macro", filters.group_cases(topic, groups, prefix + "{}"), "")
    counts = rows.groupBy(week, "macro").agg(F.count(F.lit(1)).alias("n_obs"))
    shares = windows.share_of(counts, week, "n_obs", "share", "tot")
    kept = filters.where_in(shares, "macro", [drop], negate=True)
    panel = joins.balance_panel(kept.select(week, "macro", "share"), "macro", week, 0.0)
    return windows.trailing_mean(panel, "macro", week, "share", "smooth", n)


def text_topics(posts, doc, text_col, k=20, stop_words=(), phrases=False, min_df=fixed.MIN_DF,
                max_iter=20, seed=fixed.SEED):
    """Clean, tokenise, optionally add phrases, fit topics; returns the
    documents with their topics, the term weights and the best documents."""
    # cleaning is costly, and phrases and vocabulary take several passes
    rows, path = store(posts.withColumn("tokens", textfn.tokenize(textfn.clean_post(text_col), stop_words)), "words")
    if phrases:
        rows = features.collocations(rows, doc, "tokens")
    rows = rows.withColumn("terms", features.ngrams("tokens"))
    bow, model, counted = models.fit_lda(rows, "terms", k, seed, max_iter, min_df, keep=posts.columns, words="tokens")
    drop_scratch(posts.sparkSession, path)
    assigned = models.topic_assign(model, counted)
    terms = models.topic_terms(model, bow, posts.sparkSession)
    best = models.top_docs(assigned, doc, text_col, k)
    return assigned, terms, best


def macro_mix(mix, macro_of: dict, keys=("period",), author="author") -> DataFrame:
    """Topic mix summed by macro label and normalised again per author."""
    rows = filters.assign_cases(mix, "macro", filters.group_cases("topic", macro_of), "Other")
    sums = rows.groupBy(*keys, author, "macro").agg(F.sum("value").alias("value"))
    return windows.share_of(sums, [*keys, author], "value", "share")


def author_topics_by_period(docs, date, author, terms, periods, doc="doc_id", k=15, max_iter=10,
                            families=None, family=None, min_df=fixed.DICT_NO_BELOW, seed=fixed.SEED, words=None, extra=None) -> DataFrame:
    """One topic model per period (and topic family), averaged per author.

    ``families`` maps a family name to the values of column ``family``. All
    models are fitted together (``topics.fit_many``): a document stands once for
    each model it belongs to, and every pass serves all models. A model without
    a term in ``min_df`` documents has no rows. ``words`` and ``extra`` name what
    ``terms`` are made of, see ``topics.fit_many``.
    """
    families = families or {"all": None}
    models_of = {}
    for name, months in periods.items():
        for tag, values in families.items():
            inside = F.month(date).isin(list(months))
            models_of[f"{name}/{tag}"] = inside if values is None else inside & F.col(family).isin(list(values))
    parts = [c for c in (words, extra) if c]
    rows = docs.select(doc, author, terms, *parts, F.explode(F.filter(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in models_of.items()]), lambda m: m.isNotNull())).alias("model"))
    fitted = topics.fit_many(rows, "model", terms, k, max_iter, min_df, fixed.MAX_DF, fixed.MAX_FEATURES, 0.5, 0.01, seed, keep=[author], words=words, extra=extra)
    mix = models.author_topic_mix(fitted.shares, author, k, extra=["model"])
    words = fitted.terms.withColumn("topic", F.concat_ws("/", "model", "topic"))
    words = models.top_words(words, 30).withColumn("model", F.substring_index("topic", "/", 2)).withColumn("topic", F.substring_index("topic", "/", -1))
    part = lambda n: F.split_part("model", F.lit("/"), F.lit(n))
    return mix.join(words, ["model", "topic"]).withColumn("period", part(1)).withColumn("family", part(2)).drop("model")


def event_study_report(panel, outcomes, rates=(), den="n_posts", dist="dist", entity="entity", ref=-7) -> DataFrame:
    """Event study of all outcomes; ``rates`` are divided by ``den`` first."""
    rows = panel
    for c in rates:
        rows = filters.with_rate(rows, c, den, c)
    return eventstudy.event_study(rows, outcomes, dist, entity, ref)


def compare_outcomes(study, x, y, dist="dist", ref=-7) -> DataFrame:
    """Slope, its error, Pearson and Spearman between the coefficients of two
    outcomes; the reference distance counts as 0. One row."""
    zeroed = study.withColumn("b", F.when(F.col(dist) == ref, 0.0).otherwise(F.col("b")))
    wide = reshape.to_wide(zeroed, dist, "outcome", [x, y], "b")
    line = stats.ols_simple(wide, x, y)
    return line.crossJoin(stats.corr_pair(wide, x, y, "pearson", "pearson")).crossJoin(
        stats.corr_pair(wide, x, y, "spearman", "spearman"))


def study_with_comparisons(panel, outcomes, rates=(), den="n_posts", dist="dist", entity="entity", ref=-7):
    """The whole report: the event study of all outcomes, stored, and every pair
    of outcomes compared. Returns (study, comparisons)."""
    study = settle(event_study_report(panel, outcomes, rates, den, dist, entity, ref))
    return study, compare_all(study, outcomes, dist, ref)


def compare_all(study, outcomes, dist="dist", ref=-7) -> DataFrame:
    """``compare_outcomes`` for every pair of outcomes, one row each.

    The study, one row per distance and outcome, is joined with itself by
    distance; moments and ranks of all pairs are taken at once. A pair's rows
    are the distances, so its window is small.
    """
    order = F.create_map(*[F.lit(v) for i, c in enumerate(outcomes) for v in (c, i)])
    zeroed = study.where(F.col("outcome").isin(list(outcomes))).groupBy(dist, "outcome").agg(
        F.max(F.when(F.col(dist) == ref, 0.0).otherwise(F.col("b"))).alias("b")).where(F.col("b").isNotNull())
    zeroed = settle(zeroed.withColumn("i", F.element_at(order, F.col("outcome"))))
    left, right = zeroed.select(dist, *[F.col(c).alias(f"{c}_x") for c in ("outcome", "b", "i")]), zeroed
    pairs = left.join(right, dist).where("i_x < i").select(
        F.col("outcome_x").alias("x"), F.col("outcome").alias("y"), F.col("b_x").alias("_a"), F.col("b").alias("_b"))

    def rank(c):
        ties = F.count(F.lit(1)).over(Window.partitionBy("x", "y", c))
        return F.rank().over(Window.partitionBy("x", "y").orderBy(c)) + (ties - 1) / 2

    keys = ["x", "y"]
    ranked = pairs.withColumns({"_ra": rank("_a"), "_rb": rank("_b")})
    line = stats.ols_simple(pairs, "_a", "_b", keys)
    rho = ranked.groupBy(*keys).agg(F.corr("_a", "_b").alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))
    # a pair without a common distance has a row of nothing
    names = list(outcomes)
    every = study.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for i, x in enumerate(names) for y in names[i + 1:]])).alias("c")).select("c.*")
    out = every.join(line, keys, "left").join(rho, keys, "left")
    return out.select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "slope", "intercept", "se", "pearson", "spearman", "x", "y")


def validation_curves(panel, outcomes, score="prediction", rates=(), den="n_posts", n=20,
                      rounding=None) -> tuple[DataFrame, DataFrame]:
    """Binned means and the fitted cubic for each outcome.

    Returns (points, curve). The curve holds distinct rounded (score, fit)
    pairs above the first and up to the 99th percentile.
    """
    rows = panel
    for c in rates:
        rows = filters.with_rate(rows, c, den, c)
    # cut points and fits read the few columns several times
    rows = settle(rows.select(F.col(score).cast("double").alias("x"), *[F.col(y).cast("double").alias(f"y{i}") for i, y in enumerate(outcomes)]))
    names = dict(enumerate(outcomes))
    probs = [i / n for i in range(1, n)] + [0.01, 0.99]
    # an outcome has the scores of its own rows; all outcomes are cut, binned and fitted together
    cuts = quantiles_many(rows, {i: (F.when(F.col(f"y{i}").isNotNull(), F.col("x")), probs) for i in names}, "averaged")

    def each(make):
        chain = None
        for i in names:
            chain = (F.when if chain is None else chain.when)(F.col("i") == i, make(i))
        return chain

    long = rows.select("x", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"y{i}").alias("y")) for i in names])).alias("c"))
    long = long.select("x", "c.*").dropna()
    title = each(lambda i: F.lit(names[i]))
    points = long.withColumn("bin", each(lambda i: windows.bin_number("x", cuts[i][:-2]))).groupBy("i", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))
    poly = long.withColumn("x2", F.pow("x", F.lit(2.0))).withColumn("x3", F.pow("x", F.lit(3.0)))
    fits = stats.ols_by(poly, "i", ["x", "x2", "x3"], "y")

    def fitted(i):
        if i not in fits:
            return F.lit(None).cast("double")
        beta = [float(b) for b in fits[i]["beta"]]
        value = F.lit(beta[3]) + F.col("x") * beta[0] + F.col("x2") * beta[1] + F.col("x3") * beta[2]
        return F.round(value, (rounding or fixed.CURVE_ROUNDING).get(names[i], 4))

    inner = each(lambda i: (F.col("x") > F.lit(cuts[i][-2])) & (F.col("x") <= F.lit(cuts[i][-1])))
    curve = poly.where(inner).select(title.alias("outcome"), F.round("x", 3).alias("x"), each(fitted).alias("yhat")).distinct()
    return points.select("bin", "n", "x_mean", "y_mean", title.alias("outcome")), curve.where(F.col("yhat").isNotNull())


def model_comparison(metrics, titles=None, methods=None, order=fixed.MODEL_ORDER, metric="MAE",
                     single=("Lasso", "TF")) -> DataFrame:
    """Best row per model, in table order. All rows of the ``single`` model
    are equal by nature; only its named encoding is kept."""
    rows = filters.recode(metrics, "model", titles or fixed.MODEL_TITLES)
    rows = filters.recode(rows, "method", methods or fixed.METHOD_TITLES)
    rows = aggregates.best_per_group(rows, "model", metric)
    if single:
        rows = rows.where(~((F.col("model") == single[0]) & (F.col("method") != single[1])))
    return ordering.order_categories(rows, "model", order)


def run_table(results, name="run") -> DataFrame:
    """Parameters read out of run names such as
    ``lr_3e-05_batch_32_merged_perc_0.4_len_256``."""
    params = textfn.parse_params(name, {
        "lr": "lr_(.*?)_", "batch": "_batch_(.*?)_", "perc": "perc_(.*?)_",
        "len": "_len_(.*?)$", "dataset": "_batch_[0-9]*_(.*?)_"})
    return results.withColumns(params)
