"""Text models on Spark ML, batch scoring, model choice and topics."""

from __future__ import annotations

import itertools
import random
from functools import reduce

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave import fixed
from panelweave.functions.arrays import argmax_col
from panelweave.operators import lasso, topics, trees
from panelweave.operators.aggregates import best_doc
from panelweave.operators.features import fit_bow, fit_grams, term_counts
from panelweave.operators.joins import pending, salted_join
from panelweave.operators.ordering import arg_best, top_terms
from panelweave.operators.spread import fits
from panelweave.operators.stats import regression_metrics
from panelweave.session import settle

REGRESSORS = {
    "rand_for": lambda: RandomForestRegressor(seed=fixed.SEED, numTrees=50),
    "lasso": lambda: LinearRegression(elasticNetParam=1.0, regParam=0.1),
    "boosted": lambda: GBTRegressor(seed=fixed.SEED, maxIter=20),
}
# Depths beyond 30 and no bound at all are one point: Spark's trees end at 30.
GRIDS = {
    "rand_for": {"numTrees": [100, 200, 300, 400, 500], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4],
                 "featureSubsetStrategy": ["all", "sqrt"], "subsamplingRate": [0.01, 0.21, 0.41, 0.61, 0.81, 1.0]},
    "lasso": {"regParam": [round(0.1 * i, 1) for i in range(11)]},
    "boosted": {"maxIter": [100, 200, 300, 400, 500], "maxDepth": [2, 3, 4, 6, 7, 9, 10, 11, 13, 14, 16],
                "stepSize": [round(0.01 + 0.11 * i, 2) for i in range(10)],
                "subsamplingRate": [0.1, 0.325, 0.55, 0.775, 1.0],
                "featureSubsetStrategy": [*[f"0.{i}" for i in range(1, 10)], "all"]},
}


def _points(grid, n, seed) -> list[dict]:
    """``n`` random points of a parameter grid, without repeats."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    random.Random(seed).shuffle(points)
    return points[:n]


def _draws(estimator, grid, n, seed):
    return [{estimator.getParam(k): v for k, v in p.items()} for p in _points(grid, n, seed)]


def train_regressors(df, bow, label, split="split", models=tuple(REGRESSORS), methods=("frequency", "onehot", "tf_idf"),
                     search=None, folds=5, fold_col=None, seed=fixed.SEED, key="doc_id") -> DataFrame:
    """Fit each model on each encoding and score it on every split.

    ``search`` is the number of random parameter draws (no tuning if None).
    The tuned lasso fits all draws, folds and encodings in one run
    (``lasso.search``; folds from 0 in ``fold_col``, else by the hash of ``key``,
    else, in a table without it, by the hash of the features). So do the tuned
    trees (``trees.search``) while an encoding has at most ``trees.ENTRIES``
    entries; those of larger tables are tuned one fit of Spark ML at a time.
    Result rows: method, model, split, tuned, MAE, MSE, R2.
    """
    # texts are cut into terms and counted once for all encodings
    extra = [c for c in (fold_col, key) if c and c in df.columns]
    keep = list(dict.fromkeys([split, label, *extra]))
    counted = settle(bow.transform(df, out="_counts").select(*keep, "_counts"))
    rows = {m: bow.recode(counted, m, "_counts").select(*keep, "features") for m in methods}

    def table(scored, method, name):
        return settle(regression_metrics(scored, label, "prediction", [split]).select(
            F.lit(method).alias("method"), F.lit(name).alias("model"), split,
            F.lit(bool(search)).alias("tuned"), "MAE", "MSE", "R2"))

    out, names = [], list(models)
    if search:
        every = _tuning_rows(rows, label, split, folds, fold_col, seed, key)
        size = {m: len(bow.vocabulary) for m in rows}
        if "lasso" in models:
            out += [table(scored, m, "lasso") for m, scored in _tuned_lasso(every, size, label, split, search, folds, seed)]
        grown = [name for name in models if name != "lasso"]
        if grown and trees.few(every):
            out += [table(scored, m, name) for m, name, scored in _tuned_trees(every, size, label, split, grown, search, folds, seed)]
            grown = []
        names = grown
    for method in methods if names else ():
        # read by every model and fold, and again for scoring; counts are stored already
        rows[method] = rows[method] if method == "frequency" else settle(rows[method])
        train = rows[method].where(F.col(split) == "train")
        for name in names:
            estimator = REGRESSORS[name]().setFeaturesCol("features").setLabelCol(label)
            if search:
                estimator = CrossValidator(
                    estimator=estimator, estimatorParamMaps=_draws(estimator, GRIDS[name], search, seed),
                    evaluator=RegressionEvaluator(labelCol=label, metricName="mae"),
                    numFolds=folds, seed=seed, foldCol=fold_col or "", parallelism=2)
            out.append(table(estimator.fit(train).transform(rows[method]), method, name))
    return reduce(lambda a, b: a.unionByName(b), out)


def _tuning_rows(rows, label, split, folds, fold_col, seed, key) -> DataFrame:
    """Rows of all encodings with their folds, stored for the searches."""
    if fold_col:
        fold = F.col(fold_col).cast("int")
    elif key in next(iter(rows.values())).columns:
        fold = lasso.fold_of(key, folds, seed)
    else:
        fold = F.pmod(F.xxhash64(F.lit(seed), vector_to_array("features")), F.lit(folds)).cast("int")
    return lasso.stored_rows(rows, label, [split], fold)


def _tuned_lasso(every, size, label, split, search, folds, seed):
    """(method, scored rows) for every encoding."""
    draws = [p["regParam"] for p in _points(GRIDS["lasso"], search, seed)]
    train = every.where(F.col(split) == "train").select("method", "fold", "y", "at", "value")
    _, chosen = lasso.search(train, size, draws, folds)
    scored = lasso.predict_many(every, chosen, ["method", split, "y"]).withColumn("prediction", F.get("predictions", F.lit(0)))
    scored = settle(scored.withColumnRenamed("y", label))
    return [(m, scored.where(F.col("method") == m)) for m in size]


def _tuned_trees(every, size, label, split, names, search, folds, seed):
    """(method, model, scored rows) for every encoding and kind of trees; what a
    grid leaves out is as in ``REGRESSORS``."""
    points = {}
    for name in names:
        plain = REGRESSORS[name]()
        fixed_ = {p.name: plain.getOrDefault(p) for p in plain.params if plain.hasDefault(p) or plain.isSet(p)}
        points[name] = [{k: v for k, v in {**fixed_, **point}.items() if k in trees.TAKEN} for point in _points(GRIDS[name], search, seed)]
    _, scored = trees.search(every, size, points, folds, split, seed)
    scored = scored.withColumnRenamed("y", label)
    return [(m, name, scored.where((F.col("method") == m) & (F.col("model") == name))) for m in size for name in names]


def select_best(results, metric="f1", how="max", tie=()) -> DataFrame:
    """Best run; the first one by ``tie`` wins equal metrics."""
    return arg_best(results, metric, how, tie)


def pending_runs(grid, done, keys) -> DataFrame:
    """Parameter sets without a result yet."""
    return pending(grid, done, keys)


def _fit_text(df, tokens, label, n_features, model):
    """Hashed tf-idf and ``model``. Weights and model take several passes; the
    counts are stored for them, so that texts are cut into terms only once."""
    hashing = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=n_features)
    counts = settle(hashing.transform(df).select("_tf", label))
    idf = IDF(inputCol="_tf", outputCol="features").fit(counts)
    return PipelineModel(stages=[hashing, idf, model.fit(idf.transform(counts))])


def text_score_model(df, tokens, label, n_features=1 << 14, reg=0.01):
    """Token list to a score: hashed tf-idf and a ridge regression. Apply with
    ``apply_score``, which keeps the score within [-1, 1]."""
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, solver="l-bfgs",
                             predictionCol="_raw")
    return _fit_text(df, tokens, label, n_features, model)


def apply_score(model, df, out="prediction") -> DataFrame:
    return model.transform(df).withColumn(out, F.tanh("_raw")).drop("_tf", "features", "_raw")


def multiclass_text_model(df, tokens, label, n_features=1 << 14, reg=0.01):
    """Token list to a class: the same features and multinomial regression.
    ``label`` holds class numbers from 0."""
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, family="multinomial",
                               predictionCol="_class", probabilityCol="_prob", rawPredictionCol="_raw")
    return _fit_text(df, tokens, label, n_features, model)


def apply_classes(model, df, names, prefix="topic_", out="final_pred") -> DataFrame:
    """Class probabilities as columns and the arg-max class name."""
    rows = model.transform(df).withColumn("_p", vector_to_array("_prob"))
    rows = rows.withColumns({f"{prefix}{i}": F.get("_p", F.lit(i)) for i in range(len(names))})
    best = F.array_position(F.col("_p"), F.array_max("_p")).cast("int")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), best)
    return rows.withColumn(out, named).drop("_tf", "features", "_raw", "_prob", "_class", "_p")


def apply_weights(df, doc, terms, weights, group="class", out="score") -> DataFrame:
    """Apply a model kept as a table (group, term, weight): for each document
    and group the sum of counts times weights, 0 without a known term.

    The groups are classes, topics or one score. Counts are taken inside the
    row; a table of few bytes is broadcast, else frequent terms are split.
    """
    weights = settle(weights.select(group, "term", "weight"))
    counts = term_counts(df, doc, terms)
    if fits(weights):
        met = counts.join(F.broadcast(weights), "term")
    else:
        met = salted_join(settle(counts), weights, "term")
    sums = met.groupBy(doc, group).agg(F.sum(F.col("tf") * F.col("weight")).alias(out))
    # documents x groups is the size of the result
    grid = df.select(doc).crossJoin(F.broadcast(weights.select(group).distinct()))
    return grid.join(sums, [doc, group], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def best_group(scores, doc, group="class", score="score") -> DataFrame:
    """The group with the highest score of each document; the smallest of equal ones."""
    return scores.groupBy(doc).agg(
        F.min_by(F.struct(group, score), F.struct(-F.col(score), F.col(group))).alias("_b")).select(doc, f"_b.{group}", f"_b.{score}")


def held_out_errors(df, label, prediction, split="split") -> DataFrame:
    """Error of a model on every split beside that of the constant that fits the
    training split best; ``better`` tells whether the model's is smaller."""
    centre = df.where(F.col(split) == "train").agg(F.avg(label).alias("_c"))
    rows = df.where(F.col(label).isNotNull()).crossJoin(F.broadcast(centre))
    gap, flat = F.col(label) - F.col(prediction), F.col(label) - F.col("_c")
    out = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("MAE"), F.avg(gap * gap).alias("MSE"),
                                  F.avg(F.abs(flat)).alias("MAE_constant"), F.avg(flat * flat).alias("MSE_constant"))
    return out.withColumn("better", F.col("MSE") < F.col("MSE_constant"))


def score_batches(df, model_fn, schema, done=None, key=None) -> DataFrame:
    """Run a Python model over the pending rows, batch by batch.

    ``model_fn()`` is called once per task and returns a function from a pandas
    batch to a pandas batch with the columns of ``schema``. Rows stream through
    in Arrow batches; nothing is held per group.
    """
    rows = df if done is None else pending(df, done, key)

    def run(batches):
        predict = model_fn()
        for pdf in batches:
            yield predict(pdf)

    return rows.mapInPandas(run, schema)


def linear_scorer(weights, bias, vector, doc):
    """Model factory for ``score_batches``: class scores of dense vectors."""
    import numpy as np
    w, b = np.asarray(weights, dtype=float), np.asarray(bias, dtype=float)

    def load():
        def predict(pdf):
            scores = np.vstack(pdf[vector].to_numpy()).astype(float) @ w.T + b
            out = pd.DataFrame({doc: pdf[doc].to_numpy()})
            for i in range(w.shape[0]):
                out[f"topic_{i}"] = scores[:, i]
            out["final_pred"] = scores.argmax(axis=1).astype("int64")
            return out
        return predict
    return load


def fit_lda(df, terms, k=20, seed=fixed.SEED, max_iter=20, min_df=fixed.MIN_DF, max_df=1.0,
            max_features=fixed.MAX_FEATURES, alpha=None, eta=None, keep=None, words=None):
    """Counted n-grams and a topic model; returns (bow, model, features). Every
    pass of the fit reads all documents: their counts alone, which are stored
    apart from the other columns (``keep`` limits those). Topics start as Spark
    ML's online fit of the same seed does; the passes are ``topics.fit_online``.
    ``words`` names the words whose n-grams of one and two the terms are, if so;
    the terms are then counted by number (``features.fit_grams``)."""
    made = fit_grams(df, words, terms, df.columns if keep is None else keep, max_features, min_df, max_df) if words else None
    if made:
        bow, counted = made
        lean = counted.select("features")
    else:
        bow = fit_bow(df, terms, max_features, min_df, max_df)
        counted = bow.transform(df, "frequency")
        counted = settle(counted if keep is None else counted.select(*keep, "features"))
        lean = settle(counted.select("features"))
    lda = LDA(k=k, seed=seed, maxIter=0, optimizer="online", featuresCol="features", subsamplingRate=1.0)
    if alpha is not None:
        lda = lda.setDocConcentration([alpha])
    if eta is not None:
        lda = lda.setTopicConcentration(eta)
    first = lda.fit(lean)
    model = topics.fit_online(lean, first.topicsMatrix().toArray(), first.estimatedDocConcentration().toArray(),
                              1.0 / k if eta is None else eta, max_iter)
    return bow, model, counted


def topic_assign(model, counted, prefix="topic_", out="pred", keep=None, store=True) -> DataFrame:
    """Topic shares per document as columns, and the name of the largest.

    Scoring is costly and its result feeds several reports, so it is stored
    once (``keep`` limits the stored columns). That also keeps later filters
    from being pushed into the scoring expression.
    """
    k = model.getK()
    kept = [c for c in (keep or counted.columns) if c != "features"]
    rows = model.transform(counted).select(*kept, vector_to_array("topicDistribution").alias("_t"))
    # a document without any known term comes back as zeros; its shares are even
    known = F.aggregate("_t", F.lit(0.0), lambda a, x: a + x) > 0
    rows = rows.select(*kept, "_t", known.alias("_k"))
    rows = rows.select(*kept, *[
        F.when(F.col("_k"), F.get("_t", F.lit(i))).otherwise(1.0 / k).alias(f"{prefix}{i}") for i in range(k)])
    rows = settle(rows) if store else rows
    return rows.withColumn(out, argmax_col([f"{prefix}{i}" for i in range(k)]))


def topic_terms(model, bow, spark, prefix="topic_") -> DataFrame:
    """Weight of every vocabulary term in every topic, in long form. The
    vocabulary is bounded by its ``max_features``."""
    matrix = model.topicsMatrix().toArray()
    rows = [(f"{prefix}{t}", term, float(matrix[i, t]))
            for i, term in enumerate(bow.vocabulary) for t in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "topic string, term string, weight double")


def top_words(terms, k=20) -> DataFrame:
    """The k heaviest words of each topic as one string."""
    ranked = top_terms(terms, "topic", "term", "weight", k)
    return ranked.groupBy("topic").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias("words"))


def top_docs(assigned, doc, text, k, prefix="topic_") -> DataFrame:
    """Document with the highest share of each topic."""
    long = assigned.select(doc, text, *[f"{prefix}{i}" for i in range(k)]).unpivot(
        [doc, text], [f"{prefix}{i}" for i in range(k)], "topic", "share")
    return best_doc(long, "topic", "share", doc)


def author_topic_mix(assigned, author, k, prefix="topic_", extra=()) -> DataFrame:
    """Mean topic shares per author group in long form, normalised to 1."""
    names = [f"{prefix}{i}" for i in range(k)]
    keys = [*extra, author]
    means = assigned.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
    long = means.unpivot(keys, names, "topic", "value")
    totals = long.groupBy(*keys).agg(F.sum("value").alias("_t"))
    return long.join(totals, keys).withColumn("value", F.try_divide("value", "_t")).drop("_t")
