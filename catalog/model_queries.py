"""Features, splits, text models and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import STOP, TOKENS, r, tokens
from catalog.stream_queries import SCORED, SCORED_SQL, weights
from panelweave import fixed
from panelweave.functions import text
from panelweave.functions.bins import ordinal
from panelweave.operators import features, models
from panelweave.plans import reports
from panelweave.session import store

GRAMS = TOKENS + """, grams AS (SELECT doc_id, lang, list_concat(tokens, list_transform(range(1, len(tokens)),
  lambda i: tokens[i] || ' ' || tokens[i + 1])) AS terms FROM tok)"""
STATS = GRAMS + """, long AS (SELECT doc_id, unnest(terms) AS term FROM grams), tc AS (SELECT doc_id, term, count(*) AS tf FROM long GROUP BY 1, 2),
  st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tc GROUP BY 1)"""
VOCAB = STATS + """, vocab AS (SELECT * FROM st WHERE df >= 5 AND df <= 0.8 * (SELECT count(*) FROM documents)
  ORDER BY tf DESC, term LIMIT 10000)"""


def grams(t):
    return tokens(t).withColumn("terms", features.ngrams("tokens"))


@query("term_stats", f"WITH {STATS} SELECT term, df, tf FROM st", "ST-09")
def _(t):
    return features.term_stats(grams(t), "terms")


@query("filter_vocab", f"WITH {VOCAB} SELECT term, df, tf FROM vocab", "ST-09 ST-10")
def _(t):
    return features.filter_vocab(grams(t), "terms", fixed.MIN_DF, fixed.MAX_DF, fixed.MAX_FEATURES)


@query("filter_vocab_dictionary", f"WITH {STATS} SELECT term, df, tf FROM st WHERE df >= 50 AND df <= 0.8 * (SELECT count(*) FROM documents)", "ST-10")
def _(t):
    return features.filter_vocab(grams(t), "terms")


@query("bow_table", f"WITH {VOCAB} SELECT doc_id, term, tc.tf FROM tc JOIN vocab USING (term)", "ST-09 ST-10")
def _(t):
    return features.counted_bow(grams(t), "doc_id", "terms")


@query("idf_table", f"WITH {VOCAB} SELECT term, df, tf, {r('ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1')} AS idf FROM vocab", "ST-09")
def _(t):
    rows = grams(t)
    vocab = features.filter_vocab(rows, "terms", fixed.MIN_DF, fixed.MAX_DF, fixed.MAX_FEATURES)
    return features.idf_table(vocab, F.lit(rows.count()))


def _vectors(t, method):
    rows = grams(t)
    bow = features.fit_bow(rows, "terms")
    values = features.nonzero("features")["values"]
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    top = F.coalesce(F.array_max(values), F.lit(0.0))
    return bow.transform(rows, method).select("doc_id", total.alias("total"), top.alias("top"))


@query("bow_frequency", f"WITH {VOCAB} SELECT doc_id, {r('CAST(coalesce(sum(v), 0) AS DOUBLE)')} AS total, {r('CAST(coalesce(max(v), 0) AS DOUBLE)')} AS top "
       "FROM documents LEFT JOIN (SELECT doc_id, tc.tf AS v FROM tc JOIN vocab USING (term)) USING (doc_id) GROUP BY 1", "ST-09")
def _(t):
    return _vectors(t, "frequency")


@query("bow_onehot", f"WITH {VOCAB} SELECT doc_id, {r('CAST(count(v) AS DOUBLE)')} AS total, {r('CAST(CASE WHEN count(v) > 0 THEN 1 ELSE 0 END AS DOUBLE)')} AS top "
       "FROM documents LEFT JOIN (SELECT doc_id, tc.tf AS v FROM tc JOIN vocab USING (term)) USING (doc_id) GROUP BY 1", "ST-09")
def _(t):
    return _vectors(t, "onehot")


@query("bow_tf_idf", f"""WITH {VOCAB}, w AS (SELECT doc_id, tc.tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS v FROM tc JOIN vocab USING (term)),
  n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM w GROUP BY 1)
  SELECT doc_id, {r('coalesce(sum(v / n), 0)')} AS total, {r('coalesce(max(v / n), 0)')} AS top FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1""", "ST-09")
def _(t):
    return _vectors(t, "tf_idf")


PHRASES = TOKENS + """, words AS (SELECT w, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM tok) GROUP BY 1),
  pos AS (SELECT doc_id, i, tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM tok)),
  pairs AS (SELECT a, b, count(*) AS n_ab FROM pos GROUP BY 1, 2), v AS (SELECT (SELECT count(*) FROM words) + (SELECT count(*) FROM pairs) AS v),
  phrases AS (SELECT a, b, n_ab, x.n AS n_a, y.n AS n_b, (n_ab - <m>) * v / x.n / y.n AS score FROM pairs JOIN words x ON x.w = a JOIN words y ON y.w = b, v
   WHERE n_ab > <m> AND (n_ab - <m>) * v / x.n / y.n > <s>)"""


def phrases_sql(min_count, threshold):
    return PHRASES.replace("<m>", str(min_count)).replace("<s>", str(threshold))


@query("phrase_table", f"WITH {phrases_sql(20, 10)} SELECT a, b, n_ab, n_a, n_b, {r('score')} AS score FROM phrases", "ST-11")
def _(t):
    return features.phrase_table(tokens(t), "tokens")


@query("collocations", f"""WITH RECURSIVE {phrases_sql(5, 20)}, hit AS (SELECT doc_id, i, a || '_' || b AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
   FROM pos JOIN phrases USING (a, b)),
  walk AS (SELECT doc_id, k, i AS last, true AS took, w FROM hit WHERE k = 1 UNION ALL
   SELECT h.doc_id, h.k, CASE WHEN h.i > walk.last + 1 THEN h.i ELSE walk.last END, h.i > walk.last + 1, h.w FROM walk JOIN hit h ON h.doc_id = walk.doc_id AND h.k = walk.k + 1)
  SELECT doc_id, len(tokens) + coalesce(n, 0) AS n, coalesce(added, '') AS added FROM tok LEFT JOIN
   (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS added FROM walk WHERE took GROUP BY 1) USING (doc_id)""", "ST-11")
def _(t):
    rows = features.collocations(tokens(t), "doc_id", "tokens", 5, 20.0)
    return rows.select("doc_id", F.size("tokens").alias("n"),
                       F.array_join(F.filter("tokens", lambda w: w.contains("_")), " ").alias("added"))


HASHED = "('0x' || substr(md5('42:' || {k}), 1, 8))::BIGINT"


@query("stratified_split", f"""WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {HASHED.format(k='event_id')}, event_id) AS p,
   count(*) OVER (PARTITION BY event_type) AS n FROM events), q AS (SELECT *, round(n * 0.5) AS kept FROM o),
  s AS (SELECT *, round(kept * 0.1) AS te FROM q), u AS (SELECT *, round((kept - te) * 0.1) AS va FROM s)
  SELECT event_id, CASE WHEN p <= te THEN 'test' WHEN p <= te + va THEN 'val' WHEN p <= kept THEN 'train' ELSE 'unused' END AS split FROM u""", "ST-12")
def _(t):
    return features.stratified_split(t.events, "event_type", "event_id", kept=0.5).select("event_id", "split")


GROUPED = f"""CASE WHEN {HASHED.format(k='user_id')} % 1000 < 625 THEN 'train' WHEN {HASHED.format(k='user_id')} % 1000 < 750 THEN 'val' ELSE 'test' END"""


@query("grouped_split", f"SELECT event_id, user_id, {GROUPED} AS split FROM events", "ST-13")
def _(t):
    return features.grouped_split(t.events, "user_id").select("event_id", "user_id", "split")


BALANCED = f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
  g AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1),
  o AS (SELECT user_id, row_number() OVER (PARTITION BY event_type ORDER BY {HASHED.format(k='user_id')}, user_id) AS p,
   count(*) OVER (PARTITION BY event_type) AS n FROM g)"""


@query("balanced_split", f"""{BALANCED} SELECT event_id, user_id, CASE WHEN p <= round(n * 0.625) THEN 'train'
  WHEN p <= round(n * 0.625) + round(n * 0.125) THEN 'val' ELSE 'test' END AS split FROM events JOIN o USING (user_id)""", "ST-13")
def _(t):
    return features.balanced_split(t.events, "user_id", "event_type").select("event_id", "user_id", "split")


@query("balance_report", f"""WITH s AS (SELECT {GROUPED} AS split, event_type FROM events) SELECT split, event_type, count(*) AS n,
  {r('count(*) / sum(count(*)) OVER (PARTITION BY split)')} AS share FROM s GROUP BY 1, 2""", "ST-13")
def _(t):
    return features.balance_report(features.grouped_split(t.events, "user_id"), "split", "event_type")


def scored_docs(t):
    """Labelled documents with word n-grams and a split by source."""
    # unlabelled documents are left out before their texts are cut
    rows = t.documents.select("doc_id", "lang", "source", "text").join(t.labels, "doc_id")
    rows = rows.withColumn("tokens", text.tokenize("text", STOP)).withColumn("terms", features.ngrams("tokens"))
    rows = rows.withColumn("target", F.col("quality") * 2.0 - 1.0)
    return features.grouped_split(rows, "doc_id")


@query("train_regressors", None, "ST-14")
def _(t):
    rows = scored_docs(t)
    bow = features.fit_bow(rows.where("split = 'train'"), "terms")
    return models.train_regressors(rows, bow, "target")


@query("tune_regressors", None, "ST-14")
def _(t):
    rows = scored_docs(t)
    bow = features.fit_bow(rows.where("split = 'train'"), "terms")
    return models.train_regressors(rows, bow, "target", search=10, folds=5)


@query("tune_lasso", None, "ST-14")
def _(t):
    rows = scored_docs(t)
    bow = features.fit_bow(rows.where("split = 'train'"), "terms")
    return models.train_regressors(rows, bow, "target", models=("lasso",), search=10, folds=5)


RUNS = """runs AS (SELECT p_brand AS run, avg(p_retailprice) AS f1, min(p_size) AS gap FROM part GROUP BY 1)"""


def runs(t):
    return t.part.groupBy(F.col("p_brand").alias("run")).agg(F.avg("p_retailprice").alias("f1"))


@query("select_best", f"WITH {RUNS} SELECT run FROM runs ORDER BY f1 DESC, run LIMIT 1", "ST-15")
def _(t):
    return models.select_best(runs(t), "f1", "max", ["run"]).select("run")


@query("pending_runs", "SELECT DISTINCT p_brand AS run, p_type FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand "
       "AND q.p_type = part.p_type AND q.p_size > 45)", "ST-15")
def _(t):
    grid = t.part.select(F.col("p_brand").alias("run"), "p_type", "p_size")
    return models.pending_runs(grid.drop("p_size").distinct(), grid.where("p_size > 45"), ["run", "p_type"])


@query("fit_lda_topics", None, "ST-16")
def _(t):
    bow, model, counted = models.fit_lda(grams(t), "terms", keep=["doc_id", "text"], words="tokens")
    assigned = models.topic_assign(model, counted, keep=["doc_id", "text"])
    words = models.top_words(models.topic_terms(model, bow, t.spark), 20)
    best = models.top_docs(assigned, "doc_id", "text", 20).select("topic", "doc_id", "share")
    sizes = assigned.groupBy(F.col("pred").alias("topic")).agg(F.count(F.lit(1)).alias("n_docs"))
    return words.join(best, "topic").join(sizes, "topic", "left")


MACRO_SQL = " ".join(f"WHEN pred IN ({', '.join(repr(f'topic_{m}') for m in members)}) THEN '{name}'" for name, members in fixed.MACRO_TOPICS.items())


@query("topic_share_series", f"""WITH a AS (SELECT DATE '2020-01-06' + CAST(7 * (doc_id % 30) AS INTEGER) AS w, replace(source, 'src', 'topic_') AS pred FROM documents),
  m AS (SELECT w, CASE {MACRO_SQL} ELSE '' END AS macro, count(*) AS n_obs FROM a GROUP BY 1, 2),
  s AS (SELECT w, macro, n_obs / sum(n_obs) OVER (PARTITION BY w) AS share FROM m), k AS (SELECT * FROM s WHERE macro <> 'Other'),
  g AS (SELECT macro, w, coalesce(share, 0) AS share FROM (SELECT DISTINCT macro FROM k) CROSS JOIN (SELECT DISTINCT w FROM k) LEFT JOIN k USING (macro, w))
  SELECT macro, CAST(CAST(w AS DATE) AS VARCHAR) AS week_start, {r('share')} AS share, {r('CASE WHEN count(*) OVER x = 3 THEN avg(share) OVER x END')} AS smooth
  FROM g WINDOW x AS (PARTITION BY macro ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "ST-17 J-11 W-05 W-06")
def _(t):
    rows = t.documents.select(
        F.date_add(F.lit("2020-01-06").cast("date"), (7 * (F.col("doc_id") % 30)).cast("int")).alias("week_start"),
        F.replace("source", F.lit("src"), F.lit("topic_")).alias("pred"))
    return reports.topic_share_series(rows, fixed.MACRO_TOPICS)


@query("author_topic_mix", f"""WITH s AS (SELECT label, embedding FROM embeddings), l AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM s),
  m AS (SELECT label, i, avg(abs(CAST(v AS DOUBLE))) AS v FROM l GROUP BY 1, 2)
  SELECT label::BIGINT AS label, 'topic_' || i AS topic, {r('v / sum(v) OVER (PARTITION BY label)')} AS value FROM m""", "ST-18")
def _(t):
    n = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    rows = t.embeddings.select("label", *[F.abs(F.get("embedding", F.lit(i)).cast("double")).alias(f"topic_{i}") for i in range(n)])
    return models.author_topic_mix(rows, "label", n)


@query("macro_mix", f"""WITH l AS (SELECT label, 'topic_' || i AS topic, abs(CAST(v AS DOUBLE)) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)),
  m AS (SELECT label, CASE topic WHEN 'topic_0' THEN 'A' WHEN 'topic_2' THEN 'A' WHEN 'topic_1' THEN 'B' ELSE 'Other' END AS macro, sum(v) AS s FROM l GROUP BY 1, 2)
  SELECT 'all' AS period, label::BIGINT AS label, macro, {r('s')} AS value, {r('s / sum(s) OVER (PARTITION BY label)')} AS share FROM m""", "ST-18 W-05")
def _(t):
    long = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).select(
        F.lit("all").alias("period"), "label", F.concat(F.lit("topic_"), "i").alias("topic"), F.abs(F.col("v").cast("double")).alias("value"))
    return reports.macro_mix(long, {"A": ["topic_0", "topic_2"], "B": ["topic_1"]}, author="label")


def grams_and_phrases(t):
    """Word n-grams, and the phrases found in each document after them; also the
    words and the phrases apart. Words are stored, phrases take several passes."""
    rows = store(tokens(t).drop("text"), "words")[0]
    rows = features.collocations(rows.withColumn("words", F.col("tokens")), "doc_id", "tokens")
    found = F.slice("tokens", F.size("words") + 1, F.size("tokens") - F.size("words"))
    return rows.withColumn("found", found).withColumn("terms", F.concat(features.ngrams("words"), "found"))


@query("author_topics_by_period", None, "ST-18")
def _(t):
    docs = grams_and_phrases(t).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")))
    return reports.author_topics_by_period(
        docs, "day", "lang", "terms", fixed.AUTHOR_PERIODS,
        families={"first": [f"src{i}" for i in range(10)], "second": [f"src{i}" for i in range(10, 20)]}, family="source", words="words", extra="found")


@query("score_batches", SCORED_SQL, "ST-19")
def _(t):
    dim = t.embeddings.select(F.size("embedding")).first()[0]
    w, b = weights(dim)
    return models.score_batches(t.embeddings, models.linear_scorer(w, b, "embedding", "vec_id"), SCORED)


@query("score_batches_pending", SCORED_SQL + " WHERE vec_id NOT IN (SELECT doc_id FROM labels)", "ST-19 J-07")
def _(t):
    dim = t.embeddings.select(F.size("embedding")).first()[0]
    w, b = weights(dim)
    done = t.labels.select(F.col("doc_id").alias("vec_id"))
    return models.score_batches(t.embeddings, models.linear_scorer(w, b, "embedding", "vec_id"), SCORED, done, "vec_id")


@query("text_score_model", None, "ST-20")
def _(t):
    train = scored_docs(t).where("split = 'train'")
    model = models.text_score_model(train, "terms", "target")
    return models.apply_score(model, grams(t)).select("doc_id", "prediction")


@query("text_score_held_out", None, "ST-20 ST-01")
def _(t):
    rows = scored_docs(t)
    model = models.text_score_model(rows.where("split = 'train'"), "terms", "target")
    return models.held_out_errors(models.apply_score(model, rows), "target", "prediction")


# A stored model: weights that follow from the document frequency of a term.
WEIGHT_SQL = ", w AS (SELECT g AS grp, term, CAST((df * (2 * g + 3) + tf) % 11 - <low> AS DOUBLE) / 8 AS weight FROM vocab, (SELECT unnest(range(<n>)) AS g))"
APPLIED = VOCAB + WEIGHT_SQL + """, s AS (SELECT doc_id, grp, sum(tc.tf * weight) AS v FROM tc JOIN w USING (term) GROUP BY 1, 2),
  a AS (SELECT doc_id, grp, coalesce(v, 0) AS v FROM documents CROSS JOIN (SELECT DISTINCT grp FROM w) LEFT JOIN s USING (doc_id, grp))"""


def applied(n, low):
    return APPLIED.replace("<n>", str(n)).replace("<low>", str(low))


def stored_weights(t, n, low):
    vocab = features.filter_vocab(grams(t), "terms", fixed.MIN_DF, fixed.MAX_DF, fixed.MAX_FEATURES)
    g = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("grp")
    rows = vocab.select("term", "df", "tf", g)
    return rows.select("grp", "term", (((F.col("df") * (2 * F.col("grp") + 3) + F.col("tf")) % 11 - low).cast("double") / 8).alias("weight"))


@query("text_score_applied", f"WITH {applied(1, 5)} SELECT doc_id, {r('tanh(v / 100)')} AS prediction FROM a", "ST-20")
def _(t):
    scores = models.apply_weights(grams(t), "doc_id", "terms", stored_weights(t, 1, 5), "grp")
    return scores.select("doc_id", F.tanh(F.col("score") / 100).alias("prediction"))


@query("text_classes_applied", f"""WITH {applied(3, 5)} SELECT doc_id, grp AS class, {r('v')} AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, grp) AS k FROM a) WHERE k = 1""", "ST-21")
def _(t):
    scores = models.apply_weights(grams(t), "doc_id", "terms", stored_weights(t, 3, 5), "grp")
    return models.best_group(scores, "doc_id", "grp").withColumnRenamed("grp", "class")


@query("topics_applied", f"""WITH {applied(4, 0)} SELECT doc_id, 'topic_' || grp AS topic,
  {r('CASE WHEN sum(v) OVER (PARTITION BY doc_id) > 0 THEN v / sum(v) OVER (PARTITION BY doc_id) ELSE 0.25 END')} AS share FROM a""", "ST-16 P-09")
def _(t):
    scores = models.apply_weights(grams(t), "doc_id", "terms", stored_weights(t, 4, 0), "grp")
    total = scores.groupBy("doc_id").agg(F.sum("score").alias("total"))
    share = F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.25)
    return scores.join(total, "doc_id").select("doc_id", F.concat(F.lit("topic_"), "grp").alias("topic"), share.alias("share"))


@query("multiclass_text_model", None, "ST-21")
def _(t):
    names = ["en", "fr", "de", "es"]
    rows = features.grouped_split(grams(t).withColumn("class", ordinal("lang", names).cast("double")), "doc_id")
    model = models.multiclass_text_model(rows.where("split = 'train'"), "terms", "class")
    return models.apply_classes(model, rows, names).select("doc_id", "lang", "split", "final_pred", *[f"topic_{i}" for i in range(4)])
