"""Grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    DAILY, KINDS, LABELS, PANEL, POSTS, panel, posts, r, domain_scores,
)
from panelweave import fixed
from panelweave.functions import bins, urls
from panelweave.operators import aggregates, features, filters, joins

LABEL_WEEK = "CAST(date_trunc('week', ts - INTERVAL 1 DAY) AS DATE) + 7"


@query("weekly_entity_score", f"""WITH {POSTS}, weekly AS (SELECT CAST({LABEL_WEEK} AS DATE) AS week_start, entity,
  sum(score) AS score_sum, count(*) AS score_count FROM posts GROUP BY 1, 2)
  SELECT post_id, entity, CAST(p.week_start AS VARCHAR) AS week_start, {r('score_sum / score_count')} AS final_score, score_count,
  CASE WHEN coalesce(score_count, 0) >= 3 THEN 1 ELSE 0 END AS target_train,
  CASE WHEN score_sum / score_count <= -1.01 THEN NULL WHEN score_sum / score_count <= -0.6 THEN 'far_left' WHEN score_sum / score_count <= -0.2 THEN 'center_left'
   WHEN score_sum / score_count <= 0.2 THEN 'center' WHEN score_sum / score_count <= 0.6 THEN 'center_right'
   WHEN score_sum / score_count <= 1.01 THEN 'far_right' END AS score_bin
  FROM posts p LEFT JOIN weekly USING (week_start, entity)""", "A-01 J-01 PF-08 M-01 (flagship)")
def _(t):
    rows = posts(t).withColumn("one", F.lit(1).cast("bigint"))
    weekly = aggregates.weekly_score(rows, "ts", "entity", "score", "one")
    out = joins.join_entity_week(rows, weekly)
    out = filters.flag_min(out, "score_count", fixed.MIN_WEEKLY_DOMAINS)
    return out.withColumn("score_bin", bins.cut_right("final_score")).select(
        "post_id", "entity", "week_start", "final_score", "score_count", "target_train", "score_bin")


@query("weekly_score", f"""WITH {POSTS} SELECT entity, CAST({LABEL_WEEK} AS VARCHAR)[:10] AS week_start,
  {r('sum(score)')} AS score_sum, count(*) AS score_count, {r('sum(score) / count(*)')} AS final_score
  FROM posts GROUP BY 1, 2""", "A-01 D-03")
def _(t):
    rows = posts(t).withColumn("one", F.lit(1).cast("bigint"))
    return aggregates.weekly_score(rows, "ts", "entity", "score", "one")


@query("weekly_score_same_week", f"""WITH {POSTS} SELECT entity, CAST(week_start AS VARCHAR) AS week_start,
  {r('sum(score)')} AS score_sum, count(*) AS score_count, {r('avg(score)')} AS final_score FROM posts GROUP BY 1, 2""", "A-01")
def _(t):
    rows = posts(t).withColumn("one", F.lit(1).cast("bigint"))
    return aggregates.weekly_score(rows, "ts", "entity", "score", "one", label="same_week")


@query("concat_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY 1", "A-02")
def _(t):
    return aggregates.concat_text(t.conversations, "conv_id", "text", ["turn", "text"])


@query("concat_text_parts", """SELECT lang, CAST((rn - 1) // 20 AS BIGINT) AS part, md5(string_agg(text, ' ' ORDER BY rn)) AS text FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) GROUP BY 1, 2""", "A-02 split groups")
def _(t):
    # groups above 20 rows are given in parts here, so the split path is taken
    out = aggregates.text_parts(t.documents, "lang", "text", ["doc_id"], max_rows=20)
    return out.withColumn("text", F.md5("text"))


@query("group_sums", f"WITH {PANEL} SELECT CAST(week_start AS VARCHAR) AS week_start, "
       + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in [*KINDS, "n_posts"]) + " FROM panel GROUP BY 1", "A-03")
def _(t):
    return aggregates.group_sums(panel(t), "week_start", [*KINDS, "n_posts"])


@query("mean_of_means", f"WITH {POSTS} SELECT CAST(week_start AS VARCHAR) AS week_start, {r('avg(m)')} AS score FROM "
       "(SELECT week_start, entity, avg(score) AS m FROM posts GROUP BY 1, 2) GROUP BY 1", "A-04")
def _(t):
    return aggregates.mean_of_means(posts(t), "week_start", "entity", "score")


@query("count_pivot", f"WITH {POSTS} SELECT CAST(week_start AS VARCHAR) AS week_start, "
       + ", ".join(f"nullif(count(*) FILTER (WHERE topic = '{k}'), 0) AS {k}" for k in KINDS) + " FROM posts GROUP BY 1", "A-05")
def _(t):
    return aggregates.count_pivot(posts(t), "week_start", "topic", KINDS)


@query("distinct_count", "SELECT event_type, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY 1", "A-06")
def _(t):
    return aggregates.distinct_count(t.events, "event_type", "user_id")


@query("distinct_count_approx", None, "A-06")
def _(t):
    return aggregates.distinct_count(t.events, "event_type", "user_id", approx=True)


@query("value_counts", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1", "A-07")
def _(t):
    return aggregates.value_counts(t.documents, "lang")


@query("element_counts", f"""WITH {LABELS}, d AS (SELECT regexp_extract(url, '([a-z]+\\.(com|org|net))(/|$)', 1) AS domain FROM pages)
  SELECT domain, CASE WHEN score < 0 THEN 'left' ELSE 'right' END AS side, count(*) * 2 AS n FROM d JOIN labels_dim USING (domain)
  WHERE score <> 0 GROUP BY 1, 2""", "A-08")
def _(t):
    d = urls.registered_domain("url")
    rows = t.pages.select(F.array(d, F.lit("other.test"), d).alias("domains"))
    return aggregates.element_counts(rows, "domains", domain_scores(t), "domain", "score")


@query("mean_by_doc", f"""SELECT conv_id, {r('avg(length(text))')} AS pred, CAST(min(conv_id % 5) AS BIGINT) AS label
  FROM conversations GROUP BY 1""", "A-09")
def _(t):
    rows = t.conversations.select("conv_id", F.length("text").cast("double").alias("pred"), (F.col("conv_id") % 5).alias("label"))
    return aggregates.mean_by_doc(rows, "conv_id", "pred", "label")


@query("group_max", f"SELECT c_nationkey::BIGINT AS c_nationkey, {r('max(c_acctbal)')} AS c_acctbal FROM customer GROUP BY 1", "A-10")
def _(t):
    return aggregates.group_max(t.customer, "c_nationkey", "c_acctbal")


@query("group_total", f"WITH {PANEL} SELECT CAST(week_start AS VARCHAR) AS week_start, CAST(sum(n_posts) AS BIGINT) AS n_posts FROM panel GROUP BY 1", "A-10")
def _(t):
    return aggregates.group_total(panel(t), "week_start", "n_posts")


@query("quartile_flag", """SELECT s_suppkey, CAST(s_acctbal > (SELECT quantile_cont(s_acctbal, 0.25) +
  (quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25)) FROM supplier) AS BIGINT) AS treat FROM supplier""", "A-11")
def _(t):
    return aggregates.quartile_flag(t.supplier, "s_acctbal", "treat").select("s_suppkey", "treat")


@query("histogram", f"""WITH m AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
  c AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS k FROM events, m GROUP BY 1)
  SELECT i AS bin, {r('lo + i * ((hi - lo) / 50)')} AS lower, {r('lo + (i + 1) * ((hi - lo) / 50)')} AS upper,
  coalesce(k, 0) AS n, {r('coalesce(k, 0) / n')} AS proportion FROM range(50) g(i) CROSS JOIN m LEFT JOIN c ON bin = i""", "A-12")
def _(t):
    return aggregates.histogram(t.events, "value")


@query("date_bounds", f"WITH {POSTS} SELECT entity, CAST(min(day) AS VARCHAR) AS lb, CAST(max(day) AS VARCHAR) AS ub FROM posts GROUP BY 1", "A-13")
def _(t):
    return aggregates.date_bounds(posts(t), "entity", "day")


@query("dedupe_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem", "A-14")
def _(t):
    return aggregates.dedupe(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))


@query("dedupe_by_key", f"""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""", "A-14")
def _(t):
    return aggregates.dedupe(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("best_doc", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn "
       "FROM documents) WHERE rn = 1", "A-15")
def _(t):
    return aggregates.best_doc(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("best_per_group", f"""SELECT n_regionkey::BIGINT AS n_regionkey, n_name, {r('m')} AS m FROM (SELECT *, min(m) OVER (PARTITION BY n_regionkey) AS best FROM
  (SELECT n_regionkey, n_name, avg(c_acctbal) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)) WHERE m = best""", "A-16")
def _(t):
    dim = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    means = joins.join_dim(t.customer, dim, "c_nationkey").groupBy("n_regionkey", "n_name").agg(F.avg("c_acctbal").alias("m"))
    return aggregates.best_per_group(means, "n_regionkey", "m")


@query("mean_where", f"WITH {DAILY} SELECT {r('avg(click) FILTER (WHERE day = DATE ' + chr(39) + '2024-01-08' + chr(39) + ')')} AS mean FROM panel", "A-17")
def _(t):
    return aggregates.mean_where(panel(t, "day"), "click", F.col("day") == F.lit("2024-01-08").cast("date"))


@query("split_summary", f"""WITH {PANEL}, s AS (SELECT 'individual' AS form, entity, week_start FROM posts
  UNION ALL SELECT 'merged', entity, week_start FROM panel),
  b AS (SELECT *, ('0x' || substr(md5('42:' || entity), 1, 8))::BIGINT % 1000 AS k FROM s)
  SELECT form, CASE WHEN k < 625 THEN 'train' WHEN k < 750 THEN 'val' ELSE 'test' END AS split, count(*) AS size,
  count(DISTINCT entity) AS users, count(DISTINCT week_start) AS weeks FROM b GROUP BY 1, 2""", "A-18")
def _(t):
    return aggregates.split_summary({
        "individual": features.grouped_split(posts(t), "entity"),
        "merged": features.grouped_split(panel(t), "entity")}, "split", "entity", "week_start")


@query("group_members", "SELECT source, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS ids FROM documents GROUP BY 1", "A-19")
def _(t):
    out = aggregates.group_members(t.documents, "source", "doc_id")
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))


@query("group_members_parts", "SELECT lang, doc_id FROM documents", "A-19 split groups")
def _(t):
    out = aggregates.member_parts(t.documents, "lang", "doc_id", max_rows=25)
    return out.select("lang", F.explode("ids").alias("doc_id"))
