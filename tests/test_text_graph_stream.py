"""Features, graph measures and streams against small brute-force results."""

import inspect
import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelweave.operators import features, graph, models
from panelweave.plans import panel, reports
from panelweave.session import scratch_path
from panelweave.streaming import jobs


def docs(spark):
    rng = np.random.default_rng(5)
    words = [[f"w{i}" for i in rng.zipf(1.6, 40) % 30] for _ in range(60)]
    return words, spark.createDataFrame(list(enumerate(words)), "id int, t array<string>")


def test_term_counts_and_grams(spark):
    words, df = docs(spark)
    got = {(r["id"], r["term"]): r["tf"] for r in features.term_counts(df, "id", "t").collect()}
    assert got == {(i, w): n for i, d in enumerate(words) for w, n in Counter(d).items()}
    row = df.select(features.ngrams("t", 1, 3).alias("g")).where("size(g) > 0").first()["g"]
    d = words[0]
    assert row == d + [f"{a} {b}" for a, b in zip(d, d[1:])] + [f"{a} {b} {c}" for a, b, c in zip(d, d[1:], d[2:])]
    empty = spark.createDataFrame([(1, [])], "id int, t array<string>")
    assert features.term_counts(empty, "id", "t").count() == 0


def test_bow(spark):
    words, df = docs(spark)
    bow = features.fit_bow(df, "t", max_features=8, min_df=5, max_df=0.9)
    dfs = Counter(w for d in words for w in set(d))
    tf = Counter(w for d in words for w in d)
    ok = [w for w in tf if dfs[w] >= 5 and dfs[w] <= 0.9 * 60]
    assert bow.vocabulary == sorted(ok, key=lambda w: (-tf[w], w))[:8]
    norms = [np.linalg.norm(r["features"].toArray()) for r in bow.transform(df, "tf_idf").collect()]
    assert all(np.isclose(n, 1) or n == 0 for n in norms)


def test_collocations_do_not_overlap(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, ["c"])], "id int, t array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {r["id"]: r["t"] for r in features.collocations(df, "id", "t", phrases=phrases).collect()}
    assert got == {1: ["a", "b", "c", "a", "b", "a_b", "a_b"], 2: ["c"]}


def test_splits(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 500).alias("u"), (F.col("id") % 3).alias("s"))
    split = features.grouped_split(df, "u")
    assert split.groupBy("u").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {(r["s"], r["split"]): r["count"] for r in features.stratified_split(df, "s", "id", 0.1).groupBy("s", "split").count().collect()}
    assert sizes[0, "test"] == 67 and sizes[0, "val"] == 60 and sizes[0, "train"] == 540


def test_graph(spark):
    rng = np.random.default_rng(6)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, (60, 2))] + [("n0", "n1")] * 3
    edges = spark.createDataFrame(pairs, "src string, dst string")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = {r["node"]: r for r in graph.clustering_coefficient(edges).collect()}
    for node, around in near.items():
        closed = sum(b in near[a] for a, b in itertools.combinations(sorted(around), 2))
        pairs_n = len(around) * (len(around) - 1) / 2
        assert got[node]["n_triangles"] == closed
        assert np.isclose(got[node]["coefficient"], closed / pairs_n if pairs_n else 0)
    over = {(r["orig"], r["direc"]): r["comm"] for r in graph.neighbor_overlap(edges, ["n0", "n1", "n2"]).collect()}
    assert over["n0", "n2"] == len(near["n0"] & near["n2"])
    summary = graph.graph_summary(edges).first()
    assert summary["edges"] == len(pairs) and summary["nodes"] == len({n for p in pairs for n in p})


def test_only_last_tag_meets_the_category(spark):
    df = spark.createDataFrame([(["#a", "#b"], "left"), ([], "left")], "t array<string>, c string")
    assert sorted(map(tuple, graph.cooccurrence_edges(df, "t", "c").collect())) == [("#a", "#b"), ("#b", "left")]


def test_shift_flags(spark):
    rows = [("u", 1, 0.3), ("u", 2, 0.9), ("u", 3, -0.3), ("u", 4, -0.3)]
    got = panel.shift_indicators(spark.createDataFrame(rows, "entity string, week_start int, prediction double")).orderBy("week_start").collect()
    assert got[0]["bin_change"] is None and got[0]["bin_old"] is None
    # out of a right bin counts as "to left", even when the new bin is further right
    assert got[1]["orient_change_toleft"] == 1 and got[1]["extremism_toright"] == 1
    assert got[2]["orient_change_toleft"] == 1 and got[3]["bin_change"] == 0
    assert abs(got[2]["score_diff"] + 1.2) < 1e-12


def test_topic_shares(spark):
    rows = [(1, "topic_0"), (1, "topic_4"), (2, "topic_4"), (3, "topic_2"), (4, "topic_0"), (5, "topic_0")]
    groups = {"X": (0,), "Y": (2,), "Other": (4,)}
    got = {(r["macro"], r["week_start"]): (r["share"], r["smooth"]) for r in reports.topic_share_series(
        spark.createDataFrame(rows, "week_start int, pred string"), groups).collect()}
    # week 2 holds only the dropped group, so it is absent
    assert set(got) == {(m, w) for m in "XY" for w in (1, 3, 4, 5)}
    assert got["X", 1] == (0.5, None) and np.isclose(got["X", 4][1], 0.5)


def test_streams_match_batch(spark):
    folder = scratch_path(spark, "in")
    rows = spark.range(400).select(
        F.col("id"), (F.col("id") % 7).alias("e"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(2 * id as int))").alias("ts"), F.lit(1.0).alias("s"))
    # files arrive in order of time; the repeats come last but within the delay
    for part in ("id < 200", "id >= 200", "id < 40"):
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.deduped(jobs.read_stream(spark, folder, rows.schema, "ts", files_per_trigger=1), "ts", "id", "60 days")
    out = scratch_path(spark, "out")
    jobs.append_to(stream, out, scratch_path(spark, "mark")).awaitTermination()
    assert sorted(r["id"] for r in jobs.read_appended(spark, out).collect()) == list(range(400))
    weekly = jobs.weekly_totals(jobs.read_stream(spark, folder, rows.schema, "ts", files_per_trigger=1), "ts", "e", [F.count(F.lit(1)).alias("n")], delay="60 days")
    out = scratch_path(spark, "weekly")
    jobs.upsert_to(weekly, out, scratch_path(spark, "mark")).awaitTermination()
    got = {(r["e"], r["week_start"]): r["n"] for r in jobs.read_latest(spark, out, ["e", "week_start"]).collect()}
    want = rows.union(rows.where("id < 40")).groupBy("e", F.to_date(F.date_trunc("week", "ts")).alias("w")).count()
    assert got == {(r["e"], r["w"]): r["count"] for r in want.collect()}


def test_pending_scores(spark):
    folder = scratch_path(spark, "vec")
    rows = spark.range(20).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    rows.union(rows.where("id < 5")).repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = scratch_path(spark, "scores")
    fn = models.linear_scorer([[1, 0], [0, 3]], [0, 0], "v", "id")
    schema = "id bigint, topic_0 double, topic_1 double, final_pred bigint"
    jobs.score_pending(stream, out, scratch_path(spark, "mark"), fn, schema, "id").awaitTermination()
    got = {r["id"]: r["final_pred"] for r in jobs.read_appended(spark, out).collect()}
    assert len(got) == 20 and jobs.read_appended(spark, out).count() == 20
    assert got[2] == 1 and got[10] == 0


def test_documents_without_known_terms_get_even_shares(spark):
    _, df = docs(spark)
    rows = df.unionByName(spark.createDataFrame([(99, ["never", "seen"])], "id int, t array<string>"))
    bow, model, counted = models.fit_lda(rows, "t", 3, max_iter=2, min_df=5)
    assigned = models.topic_assign(model, counted, keep=["id"])
    odd = assigned.where("id = 99").first()
    assert all(np.isclose(odd[f"topic_{i}"], 1 / 3) for i in range(3)) and odd["pred"] == "topic_0"
    shares = models.author_topic_mix(assigned, "id", 3).groupBy("id").agg(F.sum("value").alias("s")).collect()
    assert len(shares) == 61 and all(np.isclose(r["s"], 1) for r in shares)


def test_encodings_share_one_count_of_the_terms(spark, monkeypatch):
    _, df = docs(spark)
    rows = df.withColumns({"y": F.col("id") % 2 * 1.0, "split": F.when(F.col("id") < 40, "train").otherwise("test")})
    bow = features.fit_bow(rows.where("split = 'train'"), "t")
    plain = bow.transform(rows, out="n").select("id", "n")
    for method in ("frequency", "onehot", "tf_idf"):
        want = {r["id"]: r["features"] for r in bow.transform(rows, method).collect()}
        got = {r["id"]: r["features"] for r in bow.recode(plain, method, "n").collect()}
        assert want == got
        if method == "onehot":
            assert {v for r in got.values() for v in r.toArray()} == {0.0, 1.0}
    asked, real = [], features.BowModel.transform
    monkeypatch.setattr(features.BowModel, "transform", lambda *a, **k: asked.append(1) or real(*a, **k))
    out = models.train_regressors(rows, bow, "y", models=("lasso",), key="id").collect()
    assert len(asked) == 1 and len(out) == 6


def test_search_tunes_every_model_on_every_encoding(spark, monkeypatch):
    import catalog
    from catalog import model_queries
    _, df = docs(spark)
    rows = df.withColumns({"target": F.col("id") % 2 * 1.0, "split": F.when(F.col("id") < 40, "train").otherwise("test")})
    monkeypatch.setattr(model_queries, "scored_docs", lambda t: rows.withColumnRenamed("t", "terms"))
    asked = []
    real = models.train_regressors
    monkeypatch.setattr(models, "train_regressors", lambda *a, **k: asked.append((a, k)) or real(*a, **{**k, "search": 1, "folds": 2}))
    space = models.GRIDS
    for name, grid in space.items():
        for point in models._draws(models.REGRESSORS[name](), grid, 10, 1):
            models.REGRESSORS[name]().copy(point)._transfer_params_to_java()
    assert max(space["rand_for"]["numTrees"]) == max(space["boosted"]["maxIter"]) == 500
    assert max(space["rand_for"]["maxDepth"]) == 30 and max(space["boosted"]["maxDepth"]) == 16
    monkeypatch.setattr(models, "GRIDS", {"rand_for": {"numTrees": [3]}, "lasso": {"regParam": [0.1]}, "boosted": {"maxIter": [2]}})
    got = catalog.load()[0]["tune_regressors"](spark, "/root/testdata/sf0.001").collect()
    assert asked[0][1] == {"search": 10, "folds": 5}
    assert sorted((r["method"], r["model"], r["split"]) for r in got) == sorted(itertools.product(
        ("frequency", "onehot", "tf_idf"), ("rand_for", "lasso", "boosted"), ("train", "test")))
    assert all(r["tuned"] for r in got)


def test_author_topics_use_phrases_and_the_large_dictionary(spark, monkeypatch):
    import catalog
    from catalog import model_queries
    _, df = docs(spark)
    rows = df.toDF("doc_id", "tokens").withColumns({"lang": F.lit("en"), "source": F.lit("src1")})
    rows = rows.withColumn("tokens", F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("only"), i, F.lit("in"), "doc_id")),
        F.array(*map(F.lit, ["red", "fox"])), "tokens")).cache()
    monkeypatch.setattr(model_queries, "tokens", lambda t: rows)
    asked = []
    least = inspect.signature(reports.author_topics_by_period).parameters["min_df"].default
    monkeypatch.setattr(reports, "author_topics_by_period", lambda d, *a, **k: asked.append((d, k)) or d.select("doc_id"))
    run = catalog.load()[0]["author_topics_by_period"]
    run(spark, "/root/testdata/sf0.001")
    # one rule at any size
    assert [k.get("min_df", least) for _, k in asked] == [50] and not hasattr(model_queries, "DICTIONARY_ROWS")
    plain = {r["doc_id"]: r["terms"] for r in rows.select("doc_id", features.ngrams("tokens").alias("terms")).collect()}
    for r in asked[0][0].collect():
        n = len(plain[r["doc_id"]])
        assert r["terms"][:n] == plain[r["doc_id"]] and "red_fox" in r["terms"][n:]


def test_term_statistics_read_the_text_once(spark):
    rows = [(1, "b a b"), (2, "a c"), (3, ""), (4, None), (5, "a a a"), (1, "b a b")]
    df = spark.createDataFrame(rows, "id long, text string")
    words = df.select("id", F.filter(F.split("text", " "), lambda w: w != "").alias("t"))
    lists = [(i, (t or "").split()) for i, t in rows]
    tf, seen = Counter(w for _, l in lists for w in l), Counter(w for _, l in lists for w in set(l))
    every = features.term_stats(words, "t")
    assert {r["term"]: (r["df"], r["tf"]) for r in every.collect()} == {w: (seen[w], tf[w]) for w in tf}
    by = features.term_stats_by(words, "id", "t")
    assert {(r["id"], r["term"]): (r["df"], r["tf"]) for r in by.collect()} == {
        (i, w): (sum(w in l for j, l in lists if j == i), sum(l.count(w) for j, l in lists if j == i)) for i, l in lists for w in l}
    totals = features.term_totals(words, "t")
    assert {r["term"]: r["tf"] for r in totals.collect()} == tf
    counts = features.term_counts(words, "id", "t")
    for out in (every, by, totals, counts):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_nonzero_keeps_vectors_sparse(spark):
    from pyspark.ml.linalg import Vectors

    vectors = [Vectors.sparse(5, [1, 4], [2.0, 3.0]), Vectors.dense([0.0, 7.0]), Vectors.sparse(5, [], [])]
    df = spark.createDataFrame(list(enumerate(vectors)), ["i", "v"])
    got = {r["i"]: (r["n"]["at"], r["n"]["values"]) for r in df.select("i", features.nonzero("v").alias("n")).collect()}
    assert got == {0: ([1, 4], [2.0, 3.0]), 1: ([0, 1], [0.0, 7.0]), 2: ([], [])}


def test_text_models_cut_texts_into_terms_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        made.add(1)
        return text.split()

    texts = [("calm river stone", 0.0), ("loud city road", 1.0), ("green garden tree", 2.0)] * 4
    rows = spark.createDataFrame(texts, "text string, y double").withColumn("terms", cut("text"))
    for fit in (models.multiclass_text_model, models.text_score_model):
        made.value = 0
        model = fit(rows, "terms", "y", 1 << 8)
        assert made.value == len(texts)
    assert model.transform(rows).count() == len(texts)


def test_topic_passes_read_counts_alone(spark, monkeypatch):
    read, real = [], models.LDA.fit
    monkeypatch.setattr(models.LDA, "fit", lambda self, df: read.append(df.columns) or real(self, df))
    rows = spark.createDataFrame([(i, "a text", ["calm", "river"] if i % 2 else ["city", "road"]) for i in range(12)], "doc_id long, text string, terms array<string>")
    _, model, counted = models.fit_lda(rows, "terms", 2, max_iter=2, min_df=1, keep=["doc_id"])
    assert read == [["features"]] and counted.columns == ["doc_id", "features"]
    assert models.topic_assign(model, counted).count() == 12
