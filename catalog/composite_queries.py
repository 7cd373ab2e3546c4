"""Composite jobs from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    DAILY, EVENT, GROUP_SQL, GROUPS, KINDS, LABELS, LINKED, LINKS, PANEL, POSTS, SCORE_BIN, STATUS_WEEKS, TAGS,
    domain_scores, linked_posts, links, panel, posts, r, status_weeks, tagged,
)
from catalog.stats_queries import cubic_sql, study_panel
from catalog.window_queries import cut_sql
from panelweave import fixed
from panelweave.functions import dates
from panelweave.operators import filters
from panelweave.plans import panel as panel_plans
from panelweave.plans import reports, supervision

LABEL_WEEK = "CAST(CAST(date_trunc('week', ts - INTERVAL 1 DAY) AS DATE) + 7 AS DATE)"
FOUND = LINKED + ", " + LINKS + ", " + LABELS + """, long AS (SELECT post_id, entity, ts, unnest(regexp_extract_all(text, 'https?://[^\\s]+')) AS url FROM linked),
  found AS (SELECT post_id, entity, ts, regexp_extract(location, '([^./]+\\.[^./?#]+)([/?#]|$)', 1) AS domain FROM long JOIN links USING (url)
   WHERE location IS NOT NULL AND location <> 'Error'),
  weekly AS (SELECT """ + LABEL_WEEK + """ AS week_start, entity, sum(score) AS score_sum, count(*) AS score_count
   FROM found JOIN labels_dim USING (domain) GROUP BY 1, 2)"""
CUT = """CASE WHEN s <= -1.01 THEN NULL WHEN s <= -0.6 THEN 'far_left' WHEN s <= -0.2 THEN 'center_left'
   WHEN s <= 0.2 THEN 'center' WHEN s <= 0.6 THEN 'center_right' WHEN s <= 1.01 THEN 'far_right' END"""
TRAIN = FOUND + f""", train AS (SELECT p.post_id, p.entity, p.week_start, p.topic, p.ts, p.text, s, score_count, {CUT} AS score_bin
  FROM (SELECT l.*, score_sum / score_count AS s, score_count FROM linked l JOIN weekly USING (week_start, entity)) p
  WHERE score_count >= 3 AND topic IN ('click', 'purchase'))"""


def training(t):
    attrs = t.customer.select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return supervision.distant_supervision(
        linked_posts(t).drop("week_start"), links(t), domain_scores(t), attrs, ["click", "purchase"])


@query("post_domains", f"WITH {FOUND} SELECT post_id, domain FROM found", "P-01 T-01 J-08 T-02")
def _(t):
    return supervision.post_domains(linked_posts(t), links(t))


@query("distant_supervision", f"""WITH {TRAIN} SELECT post_id, entity, CAST(week_start AS VARCHAR) AS week_start, topic, {r('s')} AS final_score,
  score_count, score_bin, c_mktsegment FROM train LEFT JOIN customer ON c_custkey = entity""", "P-01")
def _(t):
    return training(t).select("post_id", "entity", "week_start", "topic", "final_score", "score_count", "score_bin", "c_mktsegment")


@query("entity_week_corpus", f"""WITH {LINKED} SELECT entity, CAST(week_start AS VARCHAR) AS week_start,
  string_agg(text, ' ' ORDER BY ts, post_id) AS text, any_value(c_mktsegment) AS c_mktsegment, any_value(c_nationkey)::BIGINT AS c_nationkey
  FROM linked JOIN customer ON c_custkey = entity WHERE topic IN ('click', 'purchase') GROUP BY 1, 2""", "P-02")
def _(t):
    attrs = t.customer.select(F.col("c_custkey").alias("entity"), "c_mktsegment", "c_nationkey")
    return supervision.entity_week_corpus(linked_posts(t), attrs, topics=["click", "purchase"])


SPLIT = "('0x' || substr(md5('42:' || entity), 1, 8))::BIGINT % 1000"


@query("training_sets", f"""WITH {TRAIN} SELECT entity, CAST(week_start AS VARCHAR) AS week_start, string_agg(text, ' ' ORDER BY ts, post_id) AS text,
  {r('min(s)')} AS final_score, min(score_bin) AS score_bin, CASE WHEN {SPLIT} < 625 THEN 'train' WHEN {SPLIT} < 750 THEN 'val' ELSE 'test' END AS split
  FROM train GROUP BY entity, week_start""", "P-03")
def _(t):
    return supervision.training_sets(training(t))[0]


@query("training_summary", f"""WITH {TRAIN}, f AS (SELECT 'individual' AS form, entity, week_start FROM train UNION ALL SELECT DISTINCT 'merged', entity, week_start FROM train)
  SELECT form, CASE WHEN {SPLIT} < 625 THEN 'train' WHEN {SPLIT} < 750 THEN 'val' ELSE 'test' END AS split, count(*) AS size,
  count(DISTINCT entity) AS users, count(DISTINCT week_start) AS weeks FROM f GROUP BY 1, 2""", "P-03 A-18")
def _(t):
    return supervision.training_sets(training(t))[1]


FLAGS = {
    "bin_change": "b <> o", "extremism": "b <> o AND b IN ('far_left', 'far_right')", "extremism_toleft": "b <> o AND b = 'far_left'",
    "extremism_toright": "b <> o AND b = 'far_right'", "orient_change": "b <> o AND o <> 'center'",
    "orient_change_toleft": "b <> o AND o IN ('center_right', 'far_right')", "orient_change_toright": "b <> o AND o IN ('center_left', 'far_left')",
}
SHIFTS = DAILY + f""", bins AS (SELECT *, {SCORE_BIN} AS b, CASE WHEN prediction <= -0.1 THEN 'left' WHEN prediction <= 0.1 THEN 'center' ELSE 'right' END AS lean FROM panel),
  lagged AS (SELECT *, lag(b) OVER w AS o, lag(lean) OVER w AS lo, prediction - lag(prediction) OVER w AS d FROM bins WINDOW w AS (PARTITION BY entity ORDER BY day))"""


@query("shift_indicators", f"""WITH {SHIFTS} SELECT entity, CAST(day AS VARCHAR) AS day, b AS score_bin, lean AS leaning, o AS bin_old, lo AS leaning_old, {r('d')} AS score_diff,
  {', '.join(f"CASE WHEN o IS NOT NULL THEN CAST({c} AS BIGINT) END AS {k}" for k, c in FLAGS.items())} FROM lagged""", "P-04")
def _(t):
    out = panel_plans.shift_indicators(panel(t, "day"), week="day")
    return out.drop("prediction", "n_posts", *KINDS)


@query("emotion_activity_panel", f"""WITH {POSTS}, n AS (SELECT week_start, entity, {', '.join(f"sum(CASE WHEN topic = '{k}' THEN 1 ELSE 0 END) AS {k}" for k in KINDS)}, count(*) AS n_posts
   FROM posts WHERE day >= DATE '2024-01-17' GROUP BY 1, 2),
  o AS (SELECT week_start, entity, {', '.join(f"sum(CASE WHEN topic = '{k}' THEN 1 ELSE 0 END) AS {k}" for k in KINDS)}, count(*) AS n_posts
   FROM posts WHERE day < DATE '2024-01-17' GROUP BY 1, 2), p AS (SELECT DISTINCT week_start, entity FROM posts)
  SELECT entity, CAST(week_start AS VARCHAR) AS week_start, {', '.join(f"CAST(coalesce(n.{k}, o.{k}) AS BIGINT) AS {k}" for k in [*KINDS, 'n_posts'])}
  FROM p LEFT JOIN n USING (week_start, entity) LEFT JOIN o USING (week_start, entity)""", "P-05")
def _(t):
    rows = posts(t).drop("week_start")
    base = panel(t).select("entity", "week_start")
    return panel_plans.emotion_activity_panel(
        base, rows.where("day >= date'2024-01-17'"), rows.where("day < date'2024-01-17'"), KINDS, emotion="topic")


@query("total_activity", f"WITH {PANEL} SELECT entity, CAST(week_start AS VARCHAR) AS week_start, n_posts, "
       "CAST(sum(n_posts) OVER (PARTITION BY week_start) AS BIGINT) AS tot_activity FROM panel", "P-06 W-05")
def _(t):
    return panel_plans.total_activity(panel(t)).select("entity", "week_start", "n_posts", "tot_activity")


MERGED = {"NATION_3": "NATION_4", "NATION_7": "NATION_8"}
REGION = "CASE n_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MERGED.items()) + " ELSE n_name END"
REGIONAL = f"""daily AS (SELECT {REGION} AS region, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, o_totalprice AS v, o_orderkey AS k FROM orders
   JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
  wk AS (SELECT region, week_start, max(v) AS tot_cases, max(k) AS tot_deaths, sum(v) AS new_cases, avg(v) AS ics_hosp FROM daily GROUP BY 1, 2),
  pop AS (SELECT {REGION} AS region, count(*) AS pop FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
  peak AS (SELECT region, max(tot_cases) / pop AS tot_cases, max(tot_deaths) / pop AS tot_deaths, max(ics_hosp) / pop AS ics_hosp, pop FROM wk JOIN pop USING (region) GROUP BY region, pop),
  comp AS (SELECT *, tot_cases * tot_deaths AS composite FROM peak)"""
MEASURES = ["tot_cases", "tot_deaths", "ics_hosp"]


def regional(t):
    daily = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.col("n_name").alias("region"), F.col("o_orderdate").alias("day"), "o_totalprice", F.col("o_orderkey"),
                     F.col("o_totalprice").alias("price")))
    weekly = panel_plans.weekly_regions(
        daily.withColumn("p2", F.col("o_totalprice")), renames=MERGED,
        maxima={"o_totalprice": "tot_cases", "o_orderkey": "tot_deaths"}, sums={"price": "new_cases"}, means={"p2": "ics_hosp"})
    names = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("region"))
    pop = filters.recode(names, "region", MERGED).groupBy("region").agg(F.count(F.lit(1)).alias("pop"))
    return weekly, panel_plans.regional_exposure(weekly, pop, MEASURES, composite=("tot_cases", "tot_deaths"))


@query("weekly_regions", f"WITH {REGIONAL} SELECT region, CAST(week_start AS VARCHAR) AS week_start, {r('tot_cases')} AS tot_cases, tot_deaths, "
       f"{r('new_cases', 2)} AS new_cases, {r('ics_hosp', 4)} AS ics_hosp FROM wk", "P-06 W-04 PF-10")
def _(t):
    return regional(t)[0].withColumn("new_cases", F.round("new_cases", 2)).withColumn("ics_hosp", F.round("ics_hosp", 4))


@query("regional_exposure", f"WITH {REGIONAL} SELECT region, pop, {', '.join(f'{r(m, 3)} AS {m}' for m in MEASURES)}, "
       + ", ".join(f"CAST({m} > (SELECT quantile_cont({m}, 0.75) FROM comp) AS BIGINT) AS treat_{m}" for m in [*MEASURES, "composite"])
       + " FROM comp", "P-06 A-11")
def _(t):
    out = regional(t)[1].drop("composite")
    return out.withColumns({m: F.round(m, 3) for m in MEASURES})


@query("apply_treatment", f"""WITH {REGIONAL}, tr AS (SELECT region, composite > (SELECT quantile_cont(composite, 0.75) FROM comp) AS treat FROM comp),
  pan AS (SELECT c_custkey, {REGION} AS region, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey
   JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3)
  SELECT c_custkey, region, CAST(week_start AS VARCHAR) AS week_start, tot_deaths, CAST(coalesce(treat, false) AS BIGINT) AS treat,
  date_diff('day', DATE '1998-02-23', week_start) || ' days_treat' AS dist_label_treat FROM pan LEFT JOIN wk USING (region, week_start) LEFT JOIN tr USING (region)""", "P-06 J-03")
def _(t):
    weekly, flags = regional(t)
    rows = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("week_start", dates.week_start("o_orderdate")).withColumnRenamed("n_name", "region"))
    rows = filters.recode(rows, "region", MERGED).groupBy("c_custkey", "region", "week_start").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("dist_label", dates.distance_label(dates.event_distance("week_start", "1998-02-23")))
    return panel_plans.apply_treatment(rows, weekly, flags).select(
        "c_custkey", "region", "week_start", "tot_deaths", "treat", "dist_label_treat")


HITS = TAGS + ", hits AS (SELECT post_id, entity, CAST(date_trunc('week', day) AS DATE) AS week_start, " + ", ".join(
    f"len(list_filter(list_distinct(tags), lambda x: {c})) AS \"{g}\"" for g, c in GROUP_SQL.items()) + " FROM tags)"


@query("tag_group_activity", f"WITH {HITS}, p AS (SELECT DISTINCT entity, week_start FROM hits) SELECT entity, CAST(week_start AS VARCHAR) AS week_start, "
       + ", ".join(f"CAST(sum(\"{g}\") AS BIGINT) AS \"{g}\"" for g in GROUPS) + " FROM p LEFT JOIN hits USING (entity, week_start) GROUP BY 1, 2", "P-07")
def _(t):
    rows = tagged(t)
    base = rows.select("entity", dates.week_start("day").alias("week_start")).distinct()
    return panel_plans.tag_group_activity(rows, base, GROUPS, ts="day")


def order_series(t):
    return status_weeks(t).select("series", "week_start", F.col("n").cast("double").alias("value"))


@query("activity_correlation_moving", f"""WITH {STATUS_WEEKS}, f AS (SELECT series, week_start, n - avg(n) OVER (PARTITION BY series ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS flat,
  (row_number() OVER (PARTITION BY series ORDER BY week_start) - 1) % 2 AS phase FROM sw), q AS (SELECT series, week_start, flat - avg(flat) OVER (PARTITION BY series, phase) AS v FROM f),
  w AS (SELECT week_start, max(v) FILTER (WHERE series = 'F') AS F, max(v) FILTER (WHERE series = 'O') AS O, max(v) FILTER (WHERE series = 'P') AS P FROM q GROUP BY 1) """ + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS rho FROM w" for a in "FOP" for b in "FOP"), "P-08")
def _(t):
    return reports.activity_correlation(order_series(t), list("FOP"), method="pearson", detrend="moving")


@query("activity_correlation", None, "P-08")
def _(t):
    return reports.activity_correlation(order_series(t), list("FOP"))


@query("correlation_network", None, "P-08 G-08")
def _(t):
    return reports.correlation_network(reports.activity_correlation(order_series(t), list("FOP")), -0.9)


@query("weekly_series", f"""WITH {STATUS_WEEKS}, {HITS} SELECT series, CAST(week_start AS VARCHAR) AS week_start, {r('CAST(n AS DOUBLE)')} AS value FROM sw WHERE series IN ('F', 'O')
  """ + "".join(f"UNION ALL SELECT '{g}', CAST(week_start AS VARCHAR), {r(f'CAST(sum(' + chr(34) + g + chr(34) + ') AS DOUBLE)')} FROM hits GROUP BY week_start " for g in GROUPS), "P-08 A-05")
def _(t):
    base = t.orders.select(dates.week_start("o_orderdate").alias("week_start"), F.col("o_orderstatus").alias("score_bin"))
    hits = panel_plans.tag_hits(tagged(t), GROUPS).withColumn("week_start", dates.week_start("day"))
    return reports.weekly_series(base, hits, ["F", "O"], list(GROUPS))


@query("text_topics", None, "P-09")
def _(t):
    assigned, terms, best = reports.text_topics(t.documents.select("doc_id", "text", "source"), "doc_id", "text", phrases=True)
    sizes = assigned.groupBy(F.col("pred").alias("topic")).agg(F.count(F.lit(1)).alias("n_docs"))
    return sizes.join(best.select("topic", "doc_id", "share"), "topic", "full_outer")


@query("text_topic_series", None, "P-09 ST-17")
def _(t):
    rows = t.documents.select("doc_id", "text", F.date_add(
        F.lit("2020-01-06").cast("date"), (7 * (F.col("doc_id") % 30)).cast("int")).alias("week_start"))
    assigned = reports.text_topics(rows, "doc_id", "text")[0]
    return reports.topic_share_series(assigned.select("week_start", "pred"), fixed.MACRO_TOPICS)


@query("event_study_report", None, "P-10 ST-04")
def _(t):
    rows = panel(t, "day").withColumn("dist", dates.event_distance("day", EVENT))
    return reports.event_study_report(rows, KINDS, KINDS)


@query("compare_outcomes", None, "P-10 ST-02 ST-06")
def _(t):
    rows = panel(t, "day").withColumn("dist", dates.event_distance("day", EVENT))
    return reports.study_with_comparisons(rows, ["click", "purchase", "prediction"], ["click", "purchase"])[1]


@query("event_wide", None, "P-10 R-03")
def _(t):
    from panelweave.operators import eventstudy
    study = eventstudy.event_study(study_panel(t), ["click", "purchase"], "dist", "entity")
    return eventstudy.event_wide(study, ["click", "purchase"])


STORED = f"""study AS (SELECT event_type AS outcome, CAST(date_diff('day', DATE '{EVENT}', CAST(ts AS DATE)) AS INTEGER) AS dist,
   avg(value) AS b, count(*) / 100.0::DOUBLE AS se, max(value) AS ul, min(value) AS ll FROM events GROUP BY 1, 2)"""


def stored_study(t):
    """A table in the form of an event study, read from the events."""
    return t.events.groupBy(
        F.col("event_type").alias("outcome"), dates.event_distance(F.to_date("ts"), EVENT).cast("int").alias("dist")).agg(
        F.avg("value").alias("b"), (F.count(F.lit(1)) / 100.0).alias("se"), F.max("value").alias("ul"), F.min("value").alias("ll"))


@query("event_wide_stored", f"WITH {STORED} SELECT dist, " + ", ".join(
    f"{r(f'max(CASE WHEN outcome = {chr(39)}{o}{chr(39)} THEN {c} END)')} AS {c}{o}" for o in ("click", "purchase") for c in ("b", "se", "ul", "ll"))
    + " FROM study GROUP BY dist", "P-10 R-03")
def _(t):
    from panelweave.operators import eventstudy
    return eventstudy.event_wide(stored_study(t), ["click", "purchase"])


def pair_sql(x, y):
    return f"""SELECT n, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('sqrt((syy - slope * sxy) / (n - 2) / sxx)')} AS se,
  {r('pearson')} AS pearson, {r('spearman')} AS spearman, '{x}' AS x, '{y}' AS y FROM
  (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy,
    corr(x, y) AS pearson, corr(a, c) AS spearman FROM
   (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS c
    FROM (SELECT dist, max(CASE WHEN outcome = '{x}' THEN z END) AS x, max(CASE WHEN outcome = '{y}' THEN z END) AS y FROM zeroed GROUP BY dist)
    WHERE x IS NOT NULL AND y IS NOT NULL))"""


OUTCOMES = ["click", "purchase", "signup"]


@query("compare_outcomes_stored", f"WITH {STORED}, zeroed AS (SELECT dist, outcome, CASE WHEN dist = -7 THEN 0.0 ELSE b END AS z FROM study) "
       + " UNION ALL ".join(pair_sql(x, y) for i, x in enumerate(OUTCOMES) for y in OUTCOMES[i + 1:]), "P-10 ST-02 ST-06")
def _(t):
    return reports.compare_all(stored_study(t), OUTCOMES)


@query("event_cells", f"""WITH {DAILY}, l AS (SELECT entity, CAST(date_diff('day', DATE '{EVENT}', day) AS INTEGER) AS dist, 'prediction' AS outcome, CAST(prediction AS DOUBLE) AS y FROM panel
   UNION ALL SELECT entity, CAST(date_diff('day', DATE '{EVENT}', day) AS INTEGER), 'n_posts', CAST(n_posts AS DOUBLE) FROM panel)
  SELECT outcome, entity, dist, CAST(count(*) AS DOUBLE) AS n, {r('sum(y)')} AS s FROM l GROUP BY 1, 2, 3""", "ST-04")
def _(t):
    from panelweave.operators import eventstudy
    rows = panel(t, "day").withColumn("dist", dates.event_distance("day", EVENT))
    return eventstudy.event_cells(rows, ["prediction", "n_posts"], "dist", "entity")


RATES = DAILY + ", rates AS (SELECT prediction, click / n_posts AS click, purchase / n_posts AS purchase FROM panel)"


@query("validation_points", f"""WITH {RATES}, {cut_sql('rates', 'prediction', 20)}, b AS (SELECT prediction, click, purchase, 1 + (SELECT count(*) FROM cuts WHERE c < prediction) AS bin FROM rates)
  SELECT 'click' AS outcome, bin, count(*) AS n, {r('avg(prediction)')} AS x_mean, {r('avg(click)')} AS y_mean FROM b GROUP BY bin
  UNION ALL SELECT 'purchase', bin, count(*), {r('avg(prediction)')}, {r('avg(purchase)')} FROM b GROUP BY bin""", "P-11")
def _(t):
    return reports.validation_curves(panel(t, "day"), ["click", "purchase"], rates=["click", "purchase"])[0]


@query("validation_curve", f"""WITH {RATES}, {cut_sql('rates', 'prediction', 100)}, {cubic_sql('rates', 'prediction', 'click')}
  SELECT DISTINCT 'click' AS outcome, {r('x', 3)} AS x, {r('yhat', 5)} AS yhat FROM fit WHERE x > (SELECT c FROM cuts WHERE k = 1) AND x <= (SELECT c FROM cuts WHERE k = 99)""", "P-11 ST-03")
def _(t):
    return reports.validation_curves(panel(t, "day"), ["click"], rates=["click"], rounding={"click": 5})[1]


METRICS = """met AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'frequency' WHEN 'O' THEN 'onehot' ELSE 'tf_idf' END AS method,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'lasso' WHEN '2' THEN 'rand_for' WHEN '3' THEN 'xgboost' WHEN '4' THEN 'catboost' ELSE 'AlBERTo' END AS model,
  avg(o_totalprice) / 1000 AS "MAE", max(o_totalprice) / 1000 AS "MSE" FROM orders GROUP BY 1, 2)"""


@query("model_comparison", f"""WITH {METRICS}, n AS (SELECT CASE model WHEN 'lasso' THEN 'Lasso' WHEN 'rand_for' THEN 'Random Forest' WHEN 'xgboost' THEN 'XGBoost' WHEN 'catboost' THEN 'CatBoost' ELSE model END AS model,
  CASE method WHEN 'frequency' THEN 'TF' WHEN 'onehot' THEN 'BIN' ELSE 'TF-IDF' END AS method, "MAE", "MSE", min("MAE") OVER (PARTITION BY model) AS best FROM met)
  SELECT model, method, {r('"MAE"')} AS "MAE", {r('"MSE"')} AS "MSE", list_position(['Lasso', 'Random Forest', 'XGBoost', 'CatBoost', 'AlBERTo'], model) - 1 AS "order"
  FROM n WHERE "MAE" = best""", "P-12")
def _(t):
    s, p = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    metrics = t.orders.groupBy(
        F.when(s == "F", "frequency").when(s == "O", "onehot").otherwise("tf_idf").alias("method"),
        F.when(p == "1", "lasso").when(p == "2", "rand_for").when(p == "3", "xgboost").when(p == "4", "catboost")
        .otherwise("AlBERTo").alias("model")).agg(
        (F.avg("o_totalprice") / 1000).alias("MAE"), (F.max("o_totalprice") / 1000).alias("MSE"))
    return reports.model_comparison(metrics, single=None)
