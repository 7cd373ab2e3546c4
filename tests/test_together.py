"""Work that serves many columns, pairs, models or intervals at once gives what
the plain way gives one at a time."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelweave.operators import aggregates, features, joins, lasso, models, spread, stats, topics, trees
from panelweave.plans import reports
from panelweave.streaming import jobs


# Intervals

def intervals(rows):
    frame = [(float(a), float(b), n) for a, b, n in rows]
    return "lb double, ub double, name string", frame


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_range_join_on_skewed_intervals(spark, few, how):
    rng = np.random.default_rng(2)
    starts = np.sort(rng.choice(4000, 300, replace=False)) * 1.0
    bounds = [(a, a + w, f"i{n}") for n, (a, w) in enumerate(zip(starts, rng.random(300) * 0.9))]
    bounds += [(1e12, 1e12 + 5, "far"), (-1e9, -5.0, "wide")]
    values = [*(rng.random(1500) * 4200 - 50).round(2), *starts[:40], *[77.25] * 400, 1e12, 1e12 + 5, 1e12 + 6, None, None, float("nan"), -7.5, -2e9]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, at double")
    schema, data = intervals(bounds)
    got = joins.range_join(df, spark.createDataFrame(data + [(None, 1.0, "none")], schema), "at", how=how, few=few)
    assert got.columns == ["id", "at", "lb", "ub", "name"]

    def hit(v):
        found = [n for a, b, n in data if v is not None and a <= v <= b]
        assert len(found) <= 1
        return found[0] if found else None

    want = {i: hit(v) for i, v in enumerate(values)}
    rows = got.collect()
    assert len(rows) == (len(values) if how == "left" else sum(n is not None for n in want.values()))
    assert all(want[r["id"]] == r["name"] for r in rows)


def test_carried_starts_cross_slices(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 600, F.lit(50)).otherwise(F.col("id")).alias("at"))
    bounds = spark.createDataFrame([(10, 700, "a"), (800, 900, "b")], "lb int, ub int, name string")
    got = joins.range_join(df, bounds, "at", few=0).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {"a": 701, "b": 101, None: 198}


def test_range_join_without_intervals(spark):
    df = spark.createDataFrame([(1, "2024-01-05")], "id long, d string").withColumn("d", F.to_date("d"))
    none = df.select(F.col("d").alias("lb"), F.col("d").alias("ub")).where("false")
    assert [r["lb"] for r in joins.range_join(df, none, "d").collect()] == [None]
    assert joins.range_join(df, none, "d", how="inner").count() == 0


# Texts by bytes

def test_texts_are_cut_by_bytes(spark):
    rows = [("u", i, chr(97 + i % 26) * 200_000) for i in range(12)] + [("v", 0, "x"), (None, 1, "p"), (None, 2, "q" * 300_000), ("u", 99, None)]
    df = spark.createDataFrame(rows, "k string, id long, t string")
    want = {k: " ".join(t for q, _, t in sorted(rows, key=lambda r: r[1]) if q == k and t) for k in ("u", "v", None)}
    whole = aggregates.concat_text(df, "k", "t", ["id"], slice_bytes=500_000).collect()
    assert {r["k"]: r["text"] for r in whole} == want and len(whole) == 3
    parts = aggregates.text_parts(df, "k", "t", ["id"], max_bytes=500_000).collect()
    by = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        by.setdefault(r["k"], []).append(r)
    assert {k: " ".join(r["text"] for r in v) for k, v in by.items()} == want
    assert [r["part"] for r in by["u"]] == list(range(len(by["u"]))) and len(by["u"]) >= 4
    # a slice ends with the text that passes the limit
    assert max(len(r["text"]) for r in parts) < 500_000 + 200_010


def test_text_beyond_one_value_fails_with_a_message(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "VALUE_BYTES", 1_000)
    df = spark.createDataFrame([("u", i, "x" * 100) for i in range(20)], "k string, id long, t string")
    with pytest.raises(Exception, match="use text_parts"):
        aggregates.concat_text(df, "k", "t", ["id"], slice_bytes=300).collect()


# Quantiles of many columns

@pytest.mark.parametrize("one_slice", [20, 100_000])
def test_quantiles_of_many_columns(spark, monkeypatch, one_slice):
    monkeypatch.setattr(spread, "SLICE_ROWS", one_slice)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.integers(0, 5, 3000) * 1.0, "c": np.where(rng.random(3000) < 0.97, 7.0, rng.random(3000)), "d": np.nan})
    frame.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(frame)
    probs = [0, 0.01, 0.1, 0.5, 0.75, 0.99, 1]
    got = spread.quantiles_many(df, {c: (c, probs) for c in frame})
    for c in "abc":
        assert np.allclose(got[c], np.quantile(frame[c].dropna(), probs))
    assert got["d"] == [None] * len(probs)
    own = spread.quantiles_many(df, {"x": (F.when(F.col("b") > 2, F.col("a")), [0.5]), "y": ("b", [0.2, 0.9])}, "averaged")
    assert np.allclose(own["x"], np.quantile(frame["a"][frame["b"] > 2].dropna(), 0.5, method="averaged_inverted_cdf"))
    assert np.allclose(own["y"], np.quantile(frame["b"], [0.2, 0.9], method="averaged_inverted_cdf"))


def test_jobs_do_not_grow_with_the_columns(spark):
    df = spark.range(500).select(*[(F.col("id") * (i + 3) % 101).cast("double").alias(f"c{i}") for i in range(12)])
    tracker = spark.sparkContext.statusTracker()

    def jobs_of(n, name):
        spark.sparkContext.setJobGroup(name, name)
        spread.quantiles_many(df, {f"c{i}": (f"c{i}", [0.1, 0.5, 0.9]) for i in range(n)})
        stats.corr_matrix(df, [f"c{i}" for i in range(n)]).collect()
        return len(tracker.getJobIdsForGroup(name))

    few, many = jobs_of(2, "few-columns"), jobs_of(12, "many-columns")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few


# Pairs of columns and outcomes

@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_corr_matrix_with_gaps(spark, method):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(size=(400, 5)) + 1e6, columns=list("abcde"))
    frame["b"] = frame["a"] * 2 + rng.normal(size=400)
    frame["e"] = 3.0
    if method == "pearson":
        frame.loc[::5, "c"] = np.nan
    df = spark.createDataFrame(frame).repartition(7)
    got = {(r["a"], r["b"]): r["rho"] for r in stats.corr_matrix(df, list("abcde"), method).collect()}
    want = frame.corr(method)
    assert len(got) == 25
    for (a, b), rho in got.items():
        assert rho is None or not math.isnan(rho)
        assert ("e" in (a, b)) == (rho is None) and (rho is None or abs(rho - want.loc[a, b]) < 1e-8)
    pair = stats.corr_pair(df, "a", "b", method).first()[0]
    assert abs(pair - want.loc["a", "b"]) < 1e-8


def test_all_outcomes_are_compared_at_once(spark):
    rng = np.random.default_rng(5)
    rows = [(f"o{i}", d * 7, None if d == -1 else float(np.round(rng.normal(), 1)), 0.1) for i in range(5) for d in range(-12, 13) if (i, d) not in ((1, 3), (2, -5))]
    rows += [("lone", 1000, 1.0, 0.1)]
    study = spark.createDataFrame(rows, "outcome string, dist int, b double, se double")
    names = [f"o{i}" for i in range(5)] + ["lone"]
    got = {(r["x"], r["y"]): r for r in reports.compare_all(study, names).collect()}
    assert len(got) == 15 and got["o0", "lone"]["n"] == 0 and got["o0", "lone"]["slope"] is None
    for x, y in [("o0", "o1"), ("o1", "o2"), ("o3", "o4")]:
        one = reports.compare_outcomes(study, x, y).first()
        for c in ("n", "slope", "intercept", "se", "pearson", "spearman"):
            assert abs(one[c] - got[x, y][c]) < 1e-9


def test_least_squares_by_group(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.choice(["p", "q"], 300), "x": rng.random(300), "z": rng.random(300)})
    frame["y"] = np.where(frame["g"] == "p", 2.0, -1.0) * frame["x"] + frame["z"] + 5
    fits = stats.ols_by(spark.createDataFrame(frame), "g", ["x", "z"], "y")
    assert np.allclose(fits["p"]["beta"], [2, 1, 5]) and np.allclose(fits["q"]["beta"], [-1, 1, 5])


# Phrases

def greedy(words, phrases):
    out, last = [], -2
    for i, pair in enumerate(zip(words, words[1:])):
        if pair in phrases and i > last + 1:
            out.append("_".join(pair))
            last = i
    return out


def test_phrases_are_filtered_inside_the_row(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    phrases = {(words[i], words[i + 1]) for i in range(0, 60, 2)} | {("w0", "w0")}
    docs = []
    for i in range(200):
        row = list(rng.choice(words, 80))
        for _ in range(6):
            a, b = sorted(phrases)[rng.integers(len(phrases))]
            row[10:10] = [a, b]
        docs.append((i, row))
    docs += [(900, []), (901, None), (902, ["w0"] * 5)]
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    table = spark.createDataFrame(sorted(phrases), "a string, b string")
    got = features.collocations(df, "id", "tokens", phrases=table).collect()
    hits = 0
    for r in got:
        words_in = dict(docs)[r["id"]]
        if words_in is None:
            assert not r["tokens"]
            continue
        assert r["tokens"] == words_in + greedy(words_in, phrases)
        hits += sum(p in phrases for p in zip(words_in, words_in[1:]))
    passed = df.select(F.explode(features.candidate_pairs("tokens", features.phrase_filter(table)))).count()
    assert hits <= passed <= 2 * hits
    none = spark.createDataFrame([], "a string, b string")
    assert features.collocations(df, "id", "tokens", phrases=none).count() == len(docs)


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_phrases_counted_by_number_equal_plain_counts(spark, monkeypatch, most):
    rng = np.random.default_rng(8)
    docs = [[f"w{int(v)}" for v in rng.zipf(1.3, 40) if v < 300] for _ in range(150)]
    df = spark.createDataFrame([*enumerate(docs), (900, []), (901, None), (902, ["w1"])], "id long, t array<string>").repartition(4)
    n, pairs = {}, {}
    for d in [*docs, ["w1"]]:
        for w in d:
            n[w] = n.get(w, 0) + 1
        for p in zip(d, d[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    want = {p: (c, n[p[0]], n[p[1]], (c - 2) * (len(n) + len(pairs)) / n[p[0]] / n[p[1]]) for p, c in pairs.items() if c > 2}
    monkeypatch.setattr(features, "PAIRED", most)
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in features.phrase_table(df, "t", 2, 1.5).collect()}
    assert got and got.keys() == {p for p, v in want.items() if v[3] > 1.5}
    assert all(np.allclose(v, want[p]) for p, v in got.items())


def test_phrases_of_rows_that_share_an_id(spark, monkeypatch):
    docs = [(1, ["a", "b", "a", "b", "c"]), (2, ["b", "c", "x"]), (2, ["x", "a", "b", "c"]), (3, ["a"]), (4, None), (None, ["a", "b"])]
    df = spark.createDataFrame(docs, "id long, t array<string>").withColumn("kept", F.size("t"))
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("a", "b"), (None, "a")], "a string, b string")

    def found(rows):
        return sorted((r["id"] or 0, r["t"] or [], r["kept"]) for r in features.collocations(rows, "id", "t", phrases=table).collect())

    looked_up = found(df)
    assert looked_up[0][1] == ["a", "b"] and looked_up[1][1] == docs[0][1] + ["a_b", "a_b"]
    alone = features.collocations(df.where("id in (1, 3, 4)"), "id", "t", phrases=table)
    assert "Join" not in alone._jdf.queryExecution().toString()
    monkeypatch.setattr(features, "fits", lambda table: False)
    assert found(df) == looked_up


def test_texts_are_cleaned_once(spark):
    rows = [(i, f"alpha beta w{i % 5} gamma delta" if i % 2 else f"rho sigma v{i % 7} tau") for i in range(120)]
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: read.add(1) or t)
    posts = spark.createDataFrame(rows, "id long, text string").withColumn("text", seen("text"))
    for phrases in (False, True):
        reports.text_topics(posts, "id", "text", k=2, min_df=2, max_iter=2, phrases=phrases)
    assert read.value == 2 * 120


# Lasso

def lasso_rows():
    rng = np.random.default_rng(10)
    x = rng.integers(0, 3, (160, 12)) * (rng.random((160, 12)) < 0.5)
    x[:, 11] = 0
    y = x[:, 0] * 1.5 - x[:, 3] * 0.7 + rng.normal(size=160) * 0.3 + 2
    return x.astype(float), y


def test_lasso_of_all_folds_and_penalties(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression
    x, y = lasso_rows()
    frame = spark.createDataFrame([(i, i % 4, float(v), Vectors.dense(row)) for i, (row, v) in enumerate(zip(x, y))], ["id", "fold", "y", "features"]).repartition(3)
    rows = lasso.stored_rows({"a": frame, "b": frame.where("id < 120")}, "y", ["id"], F.col("fold").cast("int"))
    size, penalties = {"a": 12, "b": 12}, [0.3, 0.05]
    held = np.array([-1, -1, 2, 2])
    fitted = lasso.fit_many(rows, size, {m: held for m in size}, {m: np.array(penalties * 2) for m in size}, tolerance=1e-8)
    for i, penalty in enumerate(penalties):
        model = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=penalty, tol=1e-10, maxIter=500, solver="l-bfgs").fit(frame)
        assert np.allclose(fitted["a"][0][:, i], model.coefficients.toArray(), atol=1e-4)
        assert abs(fitted["a"][1][i] - model.intercept) < 1e-4
    # a fold that is left out: the optimum over the others, on the scale of all rows
    for m, n in (("a", 160), ("b", 120)):
        use = (np.arange(n) % 4) != 2
        sd = x[:n].std(0, ddof=1)
        for i, penalty in enumerate(penalties):
            w, b = fitted[m][0][:, 2 + i], fitted[m][1][2 + i]
            gap = y[:n][use] - x[:n][use] @ w - b
            assert abs(gap.mean()) < 1e-6
            slope = x[:n][use].T @ gap / use.sum()
            for j in range(11):
                assert abs(slope[j] / sd[j] - np.sign(w[j]) * penalty) < 1e-4 if w[j] else abs(slope[j] / sd[j]) <= penalty + 1e-4
            assert w[11] == 0
    best, chosen = lasso.search(rows, size, [0.0, 0.05, 1.0], 4)
    assert best == {"a": 0.05, "b": 0.05} or set(best.values()) <= {0.0, 0.05}
    got = lasso.predict_many(rows, chosen, ["method", "id"]).collect()
    for r in got[::29]:
        w, b = chosen[r["method"]]
        assert abs(r["predictions"][0] - (x[r["id"]] @ w[:, 0] + b[0])) < 1e-9


def test_lasso_steps_carry_only_models_that_move(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    x, y = lasso_rows()
    vector = [Vectors.dense(row) if i % 2 else Vectors.sparse(12, [(j, v) for j, v in enumerate(row) if v]) for i, row in enumerate(x)]
    frame = spark.createDataFrame([(i, i % 4, float(v), row) for i, (row, v) in enumerate(zip(vector, y))], ["id", "fold", "y", "features"]).repartition(3)
    rows = lasso.stored_rows({"a": frame}, "y", ["id"], F.col("fold").cast("int"))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    asked, real = [], lasso.gradients
    monkeypatch.setattr(lasso, "gradients", lambda b, w, h: asked.append({m: v.shape[1] for m, v in w.items()}) or real(b, w, h))
    # blocks of few rows: the sums over them are those over all rows
    monkeypatch.setattr(lasso, "BLOCK_CELLS", 30)
    w, held = np.random.default_rng(1).normal(size=(12, 2)), np.array([-1, 2])
    blocks = lasso._blocks(rows, {"a": 12})
    assert blocks.count() > 20
    grad, rest, n = lasso.gradients(blocks, {"a": w}, {"a": held})["a"]
    for i, use in enumerate((np.arange(160) >= 0, np.arange(160) % 4 != 2)):
        gap = y[use] - x[use] @ w[:, i]
        assert np.allclose(grad[:, i], x[use].T @ gap) and np.isclose(rest[i], gap.sum()) and n[i] == use.sum()
    asked.clear()
    fitted = lasso.fit_many(rows, {"a": 12}, {"a": np.array([-1, -1, -1])}, {"a": np.array([100.0, 0.3, 50.0])})["a"]
    steps = [a["a"] for a in asked[lasso.POWER_STEPS + 1:]]
    assert steps[0] == 3 and set(steps[1:-1]) == {1} and steps[-1] == 3
    alone = lasso.fit_many(rows, {"a": 12}, {"a": np.array([-1])}, {"a": np.array([0.3])})["a"]
    assert not fitted[0][:, [0, 2]].any() and np.allclose(fitted[0][:, 1], alone[0][:, 0]) and np.allclose(fitted[1], [y.mean(), alone[1][0], y.mean()])


# Topics

def plain_infer(beta, docs, alpha):
    gammas, sums = [], np.zeros(beta.shape)
    for at, counts in docs:
        gamma = np.ones(beta.shape[1])
        theta = topics.expected_log(gamma[None])[0]
        for _ in range(topics.INNER_STEPS):
            norm = beta[at] @ theta + 1e-100
            new = alpha + theta * ((counts / norm) @ beta[at])
            change = np.abs(new - gamma).mean()
            gamma, theta = new, topics.expected_log(new[None])[0]
            if change < topics.INNER_CHANGE:
                break
        norm = beta[at] @ theta + 1e-100
        for j, w in enumerate(at):
            sums[w] += theta * counts[j] / norm[j]
        gammas.append(gamma)
    return np.array(gammas), sums


def test_inference_of_many_documents_is_that_of_each():
    rng = np.random.default_rng(8)
    beta = rng.random((30, 4))
    docs = [(np.sort(rng.choice(30, n, replace=False)), rng.integers(1, 5, n).astype(float)) for n in (1, 5, 12, 30, 3)]
    at, counts = (np.concatenate([d[i] for d in docs]) for i in (0, 1))
    gamma, found = topics.infer(beta, at, counts, np.cumsum([len(d[0]) for d in docs]), 0.5)
    want, sums = plain_infer(beta, docs, 0.5)
    got = np.zeros(beta.shape)
    np.add.at(got, at, found)
    assert np.allclose(gamma, want) and np.allclose(got, sums)


def test_digamma():
    assert np.allclose(topics.digamma([1.0, 0.5, 10.0]), [-0.5772156649015329, -1.9635100260214235, 2.2517525890667211])
    x = np.linspace(0.01, 20, 50)
    assert np.allclose(topics.digamma(x + 1), topics.digamma(x) + 1 / x)


def test_inference_to_the_end_rests_and_is_no_worse():
    rng = np.random.default_rng(4)
    k, alpha = 6, 0.1
    beta = rng.gamma(0.3, 1, (400, k)) + 1e-12
    sizes = np.append(rng.integers(1, 60, 40), 300)
    at = np.concatenate([rng.choice(400, n, replace=False) for n in sizes])
    counts = rng.integers(1, 4, len(at)).astype(float)
    counts[-300:] *= 50  # beyond what 32 bits begin with
    ends = np.cumsum(sizes)

    def bound(gamma):
        from math import lgamma
        out = 0.0
        for g, hi, n in zip(gamma, ends, sizes):
            e = np.log(topics.expected_log(g[None])[0])
            out += counts[hi - n:hi] @ np.log(beta[at[hi - n:hi]] @ np.exp(e)) + ((alpha - g) * e).sum() + sum(map(lgamma, g)) - lgamma(g.sum())
        return out

    begin, few = np.append(0, ends[:-1]), []
    for kind in (float, np.float32):
        gamma, theta, ratio = topics.solve((beta / beta.max(1, keepdims=True)).astype(kind), at, counts, ends, alpha, True)
        for g, lo, hi in zip(gamma, begin, ends):
            words = beta[at[lo:hi]]
            new = alpha + topics.exp_digamma(g) * ((counts[lo:hi] / (words @ topics.exp_digamma(g))) @ words)
            assert np.abs(new - g).mean() < 2e-3
        few.append(bound(gamma))
        # a document's statistics times beta share out its counts
        shared = np.repeat(theta, sizes, axis=0) * ratio[:, None] * (beta / beta.max(1, keepdims=True))[at]
        assert np.allclose(shared.sum(1), counts, rtol=1e-4)
    plain, _ = plain_infer(beta, [(at[lo:hi], counts[lo:hi]) for lo, hi in zip(begin, ends)], alpha)
    assert min(few) > bound(plain) - 1.0


def test_online_fit_is_that_of_each_document(spark):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(6)
    k, n = 3, 20
    docs = [(np.sort(rng.choice(np.arange(i % 2 * 10, i % 2 * 10 + 10), 5, replace=False)), rng.integers(1, 5, 5).astype(float)) for i in range(30)] + [(np.zeros(0, int), np.zeros(0))]
    df = spark.createDataFrame([(i, Vectors.sparse(n, a.tolist(), c.tolist())) for i, (a, c) in enumerate(docs)], ["id", "features"]).repartition(3)
    start = LDA(k=k, seed=3, maxIter=0, optimizer="online", subsamplingRate=1.0).fit(df)
    first, alpha = start.topicsMatrix().toArray(), start.estimatedDocConcentration().toArray()
    # random topics, not yet fitted
    assert first.shape == (n, k) and 0.5 < first.min() < first.max() < 1.6 and np.allclose(alpha, 1 / k)
    model = topics.fit_online(df, first, alpha, 1 / k, 4)
    weights = first
    for i in range(1, 5):
        beta, sums, elog = topics.expected_log(weights.T).T, np.zeros((n, k)), np.zeros(k)
        for a, c in docs[:-1]:
            gamma = np.ones(k)
            for _ in range(5000):
                theta = topics.exp_digamma(gamma)
                gamma = alpha + theta * ((c / (beta[a] @ theta)) @ beta[a])
            theta = topics.exp_digamma(gamma)
            sums[a] += theta * (c / (beta[a] @ theta))[:, None]
            elog += topics.digamma(gamma) - topics.digamma([gamma.sum()])
        weight = (1024 + i) ** -0.51
        weights, alpha = (1 - weight) * weights + weight * (sums * beta + 1 / k), topics._concentration(alpha, elog / 30, 30, weight)
    assert np.allclose(model.weights, weights, rtol=0.05) and np.allclose(model.alpha, alpha, rtol=0.01)
    assert model.getK() == k and np.allclose(model.topicsMatrix().toArray(), model.weights)
    shares = {r["id"]: r["topicDistribution"].toArray() for r in model.transform(df).collect()}
    assert len(shares) == 31 and not shares[30].any() and all(np.isclose(shares[i].sum(), 1) for i in range(30))


def test_concentration_finds_the_most_likely():
    rng = np.random.default_rng(2)
    true = np.array([0.3, 1.0, 2.5])
    elog = np.log(rng.dirichlet(true, 20_000)).mean(0)
    alpha = np.full(3, 1.0)
    for _ in range(400):
        alpha = topics._concentration(alpha, elog, 20_000, 0.05)
    assert np.allclose(alpha, true, rtol=0.05)
    assert np.allclose(topics.trigamma([1.0, 0.5]), [np.pi ** 2 / 6, np.pi ** 2 / 2]) and np.allclose(np.log(topics.exp_digamma(np.array([0.05, 1.0, 30.0]))), topics.digamma([0.05, 1.0, 30.0]))


def test_grams_are_counted_by_number_as_by_string(spark, monkeypatch):
    rng = np.random.default_rng(12)
    names = [f"w{i}" for i in range(60)]
    lists = [[names[min(59, int(x))] for x in rng.geometric(0.08, rng.integers(0, 25))] for _ in range(150)] + [None, [], ["w1"], ["lonely", "w2"]]
    df = spark.createDataFrame([(i % 40, f"t{i}", t) for i, t in enumerate(lists)], "id long, text string, words array<string>").repartition(4)
    plain = df.withColumn("terms", features.ngrams(F.coalesce("words", F.array().cast("array<string>"))))
    for most, low, high in ((30, 2, 1.0), (12, 5, 0.3), (5000, 3, 0.9), (40, 1, 1.0)):
        want = features.fit_bow(plain, "terms", most, low, high)
        bow, got = features.fit_grams(df, "words", "terms", ["id", "text"], most, low, high)
        assert (bow.vocabulary, bow.dfs, bow.n_docs) == (want.vocabulary, want.dfs, want.n_docs)
        rows = {r["text"]: (r["id"], r["features"]) for r in got.collect()}
        assert rows == {r["text"]: (r["id"], r["features"]) for r in want.transform(plain).collect()} and got.columns == ["id", "text", "features"]
    # the n-grams themselves are not made for a topic fit
    made = spark.sparkContext.accumulator(0)
    cut = F.udf(lambda t: made.add(1) or t, "array<string>")
    bow, model, counted = models.fit_lda(plain.withColumn("terms", cut("terms")), "terms", 2, max_iter=2, min_df=2, keep=["id"], words="words")
    assert made.value == 0 and models.topic_assign(model, counted).count() == 154
    monkeypatch.setattr(features, "NUMBERED", 0)
    assert features.fit_grams(df, "words", "terms", ["id"], 30, 2, 1.0) is None


def topic_corpus():
    rng = np.random.default_rng(9)
    themes = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)], [f"c{i}" for i in range(12)]]
    rows = []
    for i in range(240):
        theme = i % 3
        rows.append((i, f"author{theme}", "left" if i % 2 else "right", [str(w) for w in rng.choice(themes[theme], 25)] + ["common"]))
    return rows + [(500, "author0", "left", []), (501, "author1", "left", None), (502, "author1", None, ["a1"])]


def test_models_fitted_together_equal_separate_ones(spark):
    df = spark.createDataFrame(topic_corpus(), "id long, author string, part string, terms array<string>").repartition(5)
    both = topics.fit_many(df, "part", "terms", k=3, max_iter=8, min_df=5, keep=["id", "author"])
    shares = both.shares.toPandas().sort_values("id").reset_index(drop=True)
    assert len(shares) == 242 and np.allclose(shares[["topic_0", "topic_1", "topic_2"]].sum(axis=1), 1)
    assert np.allclose(shares[shares["id"] >= 500][["topic_0", "topic_1", "topic_2"]], 1 / 3)
    terms = both.terms.toPandas()
    assert "common" not in set(terms["term"]) and set(terms["part"]) == {"left", "right"}
    for part in ("left", "right"):
        alone = topics.fit_many(df.where(F.col("part") == part), "part", "terms", k=3, max_iter=8, min_df=5, keep=["id", "author"])
        mine = shares[shares["part"] == part].reset_index(drop=True)
        assert np.allclose(alone.shares.toPandas().sort_values("id")[["topic_0", "topic_1", "topic_2"]].to_numpy(), mine[["topic_0", "topic_1", "topic_2"]].to_numpy(), atol=1e-6)
    # the three themes come apart
    held = shares[shares["id"] < 500]
    best = held[["topic_0", "topic_1", "topic_2"]].to_numpy().argmax(1)
    for part in ("left", "right"):
        inside = (held["part"] == part).to_numpy()
        pairs = {(a, b) for a, b in zip(held["author"][inside], best[inside])}
        assert len(pairs) == 3


def test_models_of_numbered_grams_equal_those_of_terms(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, author, part, terms and terms[:rng.integers(26)], terms and [f"a{rng.integers(4)}_a1", "a1"][:rng.integers(3)]) for i, author, part, terms in topic_corpus()]
    df = spark.createDataFrame(rows, "id long, author string, part string, words array<string>, found array<string>").repartition(5)
    df = df.withColumn("terms", F.concat(features.ngrams("words"), "found"))
    made = spark.sparkContext.accumulator(0)
    cut = F.udf(lambda t: made.add(1) or t, "array<string>")
    limits = {"k": 3, "max_iter": 3, "min_df": 3, "keep": ["id"]}
    for most in (10_000, 60, 30):
        plain = topics.fit_many(df, "part", "terms", max_terms=most, **limits)
        coded = topics.fit_many(df.withColumn("terms", cut("terms")), "part", "terms", max_terms=most, words="words", extra="found", **limits)
        want, got = ({(r["part"], r["topic"], r["term"]): r["weight"] for r in f.terms.collect()} for f in (plain, coded))
        assert want.keys() == got.keys() and all(any(mark in k[2] for k in got) == (most > 30) for mark in " _")
        assert np.allclose([want[k] for k in want], [got[k] for k in want])
        shares = [f.shares.toPandas().sort_values("id").reset_index(drop=True) for f in (plain, coded)]
        assert len(shares[1]) == 242 and list(shares[1]["part"]) == list(shares[0]["part"]) and np.allclose(*[x[["topic_0", "topic_1", "topic_2"]] for x in shares])
    # lists of terms are not made
    assert made.value == 0
    assert topics.fit_many(df, "part", "terms", **{**limits, "min_df": 500}, words="words", extra="found").terms.count() == 0
    monkeypatch.setattr(features, "NUMBERED", 0)
    assert features.fit_grams_by(df, "part", "words", "found", ["id"], 30, 3, 1.0) is None


def test_a_model_without_terms_is_left_out(spark):
    df = spark.createDataFrame(topic_corpus()[:9], "id long, author string, part string, terms array<string>")
    none = topics.fit_many(df, "part", "terms", k=3, min_df=50, keep=["id"])
    assert none.shares.count() == 0 and none.terms.count() == 0


def test_author_topics_of_all_periods(spark):
    rows = spark.createDataFrame(topic_corpus()[:240], "doc_id long, author string, part string, terms array<string>")
    rows = rows.withColumn("day", F.date_add(F.lit("2024-03-01").cast("date"), (F.col("doc_id") % 100).cast("int")))
    out = reports.author_topics_by_period(rows, "day", "author", "terms", {"spring": (3, 4), "both": (4, 5, 6)}, k=3, max_iter=4,
                                          families={"l": ["left"], "r": ["right"]}, family="part", min_df=5).toPandas()
    assert set(zip(out["period"], out["family"])) == {(p, f) for p in ("spring", "both") for f in "lr"}
    assert np.allclose(out.groupby(["period", "family", "author"])["value"].sum(), 1) and (out["words"].str.len() > 0).all()
    assert len(out) == 2 * 2 * 3 * 3


# Streams

def test_settings_of_a_stream_come_and_go(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    seen = jobs.start_on_disk(spark, lambda: spark.conf.get(key))
    assert seen.endswith("RocksDBStateStoreProvider") and spark.conf.get(key, None) == before


def test_scored_ids_stay_scored_over_restarts(spark, tmp_path):
    schema = "id long, v double"

    def model():
        return lambda pdf: pdf.assign(s=pdf["v"] * 2)[["id", "s"]]

    def run(n, ids):
        spark.createDataFrame([(i, float(i)) for i in ids], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        jobs.score_pending(stream, f"{tmp_path}/out", f"{tmp_path}/mark", model, "id long, s double", "id").awaitTermination()
        return sorted((r["id"], r["s"]) for r in jobs.read_appended(spark, f"{tmp_path}/out").collect())

    assert run(0, range(10)) == [(i, 2.0 * i) for i in range(10)]
    assert run(1, range(5, 15)) == [(i, 2.0 * i) for i in range(15)]
    state = [p.name for p in (tmp_path / "mark" / "state").rglob("*")]
    assert any(n.endswith((".changelog", ".zip")) for n in state)


def tree_rows(spark, n=90, seed=5):
    """Counts, a yes-or-no and a measured feature; the goal hangs on two of them."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 4, n), rng.integers(0, 2, n), np.where(rng.random(n) < 0.5, rng.random(n).round(2), 0)]).astype(float)
    y = 2.0 * (x[:, 0] >= 2) - x[:, 1] * (x[:, 0] < 2) + rng.normal(0, 0.05, n)
    frame = spark.createDataFrame([(i, i % 3, "train" if i < 60 else "test", Vectors.sparse(3, [(j, v) for j, v in enumerate(r) if v]), float(t))
                                   for i, (r, t) in enumerate(zip(x, y))], ["id", "fold", "split", "features", "y"])
    rows = lasso.stored_rows({"a": frame}, "y", ["split"], F.col("fold").cast("int"))
    blocks, feature = trees.binned(rows, {"a": 3}, "split")
    return x, y, rows, trees._Rows(blocks.where("method = 'a'").collect(), feature["a"], False)


def plain_tree(cells, weight, goal, depth, least, out, at):
    """Regression tree by trying every split; ``out`` gets the values of ``at``."""
    w = weight[at]
    mean = (w * goal[at]).sum() / w.sum()
    out[at] = mean
    best = (1e-9, None)
    for j in range(cells.shape[1]):
        for c in np.unique(cells[at, j]):
            over = cells[at, j] >= c
            if depth and min(w[over].sum(), w[~over].sum()) >= max(least, 0.5):
                sides = [np.average(goal[at][k], weights=w[k]) for k in (over, ~over)]
                gain = w[over].sum() * (sides[0] - mean) ** 2 + w[~over].sum() * (sides[1] - mean) ** 2
                best = max(best, (gain, (j, c)), key=lambda b: b[0] + 1e-9 * (b[1] is None))
    if best[1]:
        over = cells[at, best[1][0]] >= best[1][1]
        plain_tree(cells, weight, goal, depth - 1, least, out, at[over])
        plain_tree(cells, weight, goal, depth - 1, least, out, at[~over])


def test_trees_over_nonzero_features_equal_plain_trees(spark):
    x, _, rows, held = tree_rows(spark)
    # bins as cells: zero has none, a feature's own are neighbours and ascend
    cells = np.full((len(held.y), 3), -1)
    owner = np.repeat(np.arange(len(held.y)), held.each)
    cells[owner, held.feature[held.cell]] = held.cell
    assert (held.part == "train").sum() == 60 and (held.fold == -2).sum() == 30
    for a in range(0, len(cells), 7):
        for j in range(3):
            higher = cells[:, j] > cells[a, j]
            assert cells[a, j] == -1 or held.feature[cells[a, j]] == j
            assert not higher.any() or cells[higher, j].min() > cells[a, j]
    rng = np.random.default_rng(0)
    for depth, least, weight in ((2, 1, np.ones(60)), (8, 1, np.ones(60)), (30, 3, rng.poisson(1.0, 60).astype(float))):
        row = np.flatnonzero(held.part == "train")
        row, weight = row[weight > 0], weight[weight > 0]
        got = trees.grow(held, np.arange(90), row, weight, held.y[row], depth, least, 3, rng)
        want = np.zeros(60)
        at = np.arange(len(row))
        plain_tree(cells[row], weight, held.y[row], depth, least, want, at)
        assert np.allclose(got[row], want[:len(row)])
    # one of three features is tried at each node: other trees, still of the bag's values
    some = trees.grow(held, np.arange(90), row, weight, held.y[row], 30, 1, 1, np.random.default_rng(1))
    assert not np.allclose(some, got) and held.y[row].min() <= some.min() <= some.max() <= held.y[row].max()
    # Spark's boosting: whole first tree, then steps on twice the rest
    p = {"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "stepSize": 0.3}
    fit, want = np.flatnonzero(held.part == "train"), np.zeros(90)
    for i in range(3):
        goal = held.y[fit] if i == 0 else 2 * (held.y[fit] - want[fit])
        want += (1.0 if i == 0 else 0.3) * trees.grow(held, np.arange(90), fit, np.ones(60), goal, 2, 1, 3, rng)
    assert np.allclose(trees.boosted(held, fit, np.arange(90), p, rng), want)
    assert np.allclose(trees.boosted(held, fit, np.arange(60, 90), p, rng), want[60:])
    # an empty bag gives no value but zero
    none = np.zeros(0, int)
    assert not trees.grow(held, np.arange(90), none, none.astype(float), none.astype(float), 3, 1, 3, rng).any()


def test_trees_are_tuned_together(spark, monkeypatch):
    x, y, rows, _ = tree_rows(spark)
    base = {"minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    points = {"rand_for": [{**base, "numTrees": 1, "maxDepth": 0}, {**base, "numTrees": 12, "maxDepth": 6}],
              "boosted": [{**base, "maxIter": 1, "maxDepth": 0, "stepSize": 0.1}, {**base, "maxIter": 8, "maxDepth": 3, "stepSize": 0.3}]}
    monkeypatch.setattr(trees, "PORTION", 5)
    asked, real = [], trees.predicted
    monkeypatch.setattr(trees, "predicted", lambda b, f, runs, *a: asked.append(runs) or real(b, f, runs, *a))
    chosen, scored = trees.search(rows, {"a": 3}, points, 3, "split", 1)
    # every draw and fold in one job, the chosen ones in another
    assert [len(a) for a in asked] == [2 * 2 * 3, 2]
    assert chosen == {("a", "rand_for"): 1, ("a", "boosted"): 1}
    got = scored.collect()
    assert len(got) == 2 * 90 and sorted({(r["model"], r["split"]) for r in got}) == [(m, s) for m in ("boosted", "rand_for") for s in ("test", "train")]
    for r in got:
        assert abs(r["prediction"] - r["y"]) < 1.0
    assert sorted(round(r["y"], 9) for r in got if r["model"] == "boosted") == sorted(y.round(9))

    # a fold's prediction does not read its labels
    blocks, feature = trees.binned(rows.withColumn("y", F.when(F.col("fold") == 0, 1e6).otherwise(F.col("y"))), {"a": 3}, "split")
    told = real(blocks, feature, [("a", "rand_for", 1, 0), ("a", "boosted", 1, 0)], points, 1).collect()
    assert len(told) == 2 * 20 and max(r["prediction"] for r in told) < 10


def test_tuned_trees_take_no_fit_after_the_other(spark, monkeypatch):
    rows = spark.range(60).select("id", F.when(F.col("id") < 40, "train").otherwise("test").alias("split"), (F.col("id") % 2).cast("double").alias("y"),
                                  F.when(F.col("id") % 2 == 1, F.array(F.lit("b"), F.concat(F.lit("a"), F.col("id") % 5))).otherwise(F.array(F.lit("c"))).alias("t"))
    bow = features.fit_bow(rows.where("split = 'train'"), "t", min_df=2, max_df=1.0)
    monkeypatch.setattr(models, "GRIDS", {"rand_for": {"numTrees": [2, 4]}, "boosted": {"maxIter": [2, 3]}})
    monkeypatch.setattr(models, "CrossValidator", None)
    kept = {"models": ("rand_for", "boosted"), "search": 2, "folds": 2, "key": "id"}
    got = models.train_regressors(rows, bow, "y", **kept).collect()
    assert len(got) == 3 * 2 * 2 and all(r["MAE"] < 0.3 for r in got)
    # more rows than may go to every task: Spark ML's own trees
    calls = []
    monkeypatch.setattr(trees, "ENTRIES", 10)
    monkeypatch.setattr(trees, "search", None)

    class Asked:
        def __init__(self, **k):
            calls.append(k)
            self.estimator = k["estimator"]

        def fit(self, train):
            return self.estimator.fit(train)

    monkeypatch.setattr(models, "CrossValidator", Asked)
    assert len(models.train_regressors(rows, bow, "y", **{**kept, "models": ("rand_for",)}, methods=("onehot",)).collect()) == 2
    assert [(c["numFolds"], len(c["estimatorParamMaps"])) for c in calls] == [(2, 2)]
