"""Projection, filters, conditional columns and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import PANEL, POSTS, panel, posts, r
from panelweave import fixed
from panelweave.operators import filters, quality

DAY = "CAST(day AS VARCHAR) AS day"


@query("project", "SELECT l_orderkey AS order_id, l_partkey AS part, "
       f"{r('l_quantity')} AS quantity FROM lineitem", "PF-01")
def _(t):
    return filters.project(t.lineitem, ["l_orderkey", "l_partkey", "l_quantity"],
                           {"l_orderkey": "order_id", "l_partkey": "part", "l_quantity": "quantity"})


@query("where_eq", "SELECT event_id, user_id FROM events WHERE event_type = 'click'", "PF-02")
def _(t):
    return filters.where_eq(t.events, "event_type", "click").select("event_id", "user_id")


@query("where_in", "SELECT doc_id, lang, 1 AS kept FROM documents WHERE lang IN ('en', 'fr') "
       "UNION ALL SELECT doc_id, lang, 0 FROM documents WHERE lang NOT IN ('en', 'fr')", "PF-03")
def _(t):
    kept = filters.where_in(t.documents, "lang", ["en", "fr"]).select("doc_id", "lang", F.lit(1).alias("kept"))
    rest = filters.where_in(t.documents, "lang", ["en", "fr"], negate=True)
    return kept.unionByName(rest.select("doc_id", "lang", F.lit(0).alias("kept")))


@query("where_date", f"WITH {POSTS} SELECT post_id, {DAY} FROM posts "
       "WHERE day > DATE '2024-01-08' AND day <= DATE '2024-01-22'", "PF-04")
def _(t):
    return filters.where_date(posts(t), "day", "2024-01-08", "2024-01-22", lo_open=True).select("post_id", "day")


@query("drop_sentinels", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error') "
       "AND user_id <> 0", "PF-05")
def _(t):
    rows = filters.drop_sentinels(t.events, "event_type", ["error"])
    return filters.drop_sentinels(rows, "user_id", [0]).select("event_id", "event_type")


@query("drop_nulls", "SELECT e.event_id, l.quality::BIGINT AS quality FROM events e JOIN labels l "
       "ON l.doc_id = e.event_id WHERE l.quality IS NOT NULL", "PF-06")
def _(t):
    rows = t.events.join(t.labels, F.col("event_id") == F.col("doc_id"), "left")
    return filters.drop_nulls(rows, "quality").select("event_id", "quality")


@query("where_positive", f"WITH {PANEL} SELECT entity, CAST(week_start AS VARCHAR) AS week_start, click "
       "FROM panel WHERE click > 0", "PF-07")
def _(t):
    return filters.where_positive(panel(t), "click").select("entity", "week_start", "click")


@query("flag_min", "SELECT d.doc_id, CASE WHEN l.quality >= 1 THEN 1 ELSE 0 END AS target_train "
       "FROM documents d LEFT JOIN labels l USING (doc_id)", "PF-08")
def _(t):
    return filters.flag_min(t.documents.join(t.labels, "doc_id", "left"), "quality", 1).select("doc_id", "target_train")


@query("near_extreme", """WITH m AS (SELECT max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders)
SELECT 'top' AS side, o_orderkey FROM orders, m WHERE o_totalprice > hi * 0.99
UNION ALL (SELECT 'low' AS side, o_orderkey FROM orders, m WHERE o_totalprice < lo * 1.5
  ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 1)""", "PF-09")
def _(t):
    top = filters.near_extreme(t.orders, "o_totalprice").select(F.lit("top").alias("side"), "o_orderkey")
    low = filters.near_extreme(t.orders, "o_totalprice", 1.5, "min", 2, ["o_totalprice", "o_orderkey"])
    return top.unionByName(low.select(F.lit("low").alias("side"), "o_orderkey"))


@query("recode", "SELECT event_id, CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' "
       "WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events", "PF-10")
def _(t):
    return filters.recode(t.events, "event_type", {"click": "act", "purchase": "act", "view": "look"}).select(
        "event_id", "event_type")


@query("assign_cases", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1000 THEN 'dear'
  ELSE p_brand END AS kind FROM part""", "PF-11")
def _(t):
    return filters.assign_cases(t.part, "kind", [
        (F.col("p_size") < 10, "small"), (F.col("p_retailprice") > 1000, "dear")], F.col("p_brand")).select(
        "p_partkey", "kind")


@query("with_constants", "SELECT event_id, 1 AS n_posts, CAST(100.0 AS DOUBLE) AS final_score, 'pre' AS period FROM events", "PF-12")
def _(t):
    return filters.with_constants(t.events.select("event_id"), n_posts=1, final_score=100.0, period="pre")


@query("with_rate", f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  {r('l_extendedprice / nullif(l_discount, 0)')} AS rate FROM lineitem""", "PF-13")
def _(t):
    return filters.with_rate(t.lineitem, "l_extendedprice", "l_discount", "rate").select(
        "l_orderkey", "l_linenumber", "rate")


@query("coalesce_from", "SELECT d.doc_id, coalesce(l.quality, d.n_chars)::BIGINT AS quality "
       "FROM documents d LEFT JOIN labels l USING (doc_id)", "PF-14")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("n_chars").alias("quality_old"))
    return filters.coalesce_from(rows, {"quality": "quality_old"})


PERIOD_ROWS = ", ".join(f"('{p}', {m})" for p, months in fixed.TOPIC_PERIODS.items() for m in months)


@query("expand_periods", f"""SELECT o_orderkey, period FROM orders
  JOIN (VALUES {PERIOD_ROWS}) v(period, m) ON m = month(o_orderdate)""", "PF-15")
def _(t):
    return filters.expand_periods(t.orders, "o_orderdate", fixed.TOPIC_PERIODS).select("o_orderkey", "period")


@query("fill_default", """SELECT e.event_id, CASE WHEN trim(x) = '' OR x IS NULL THEN 'other' ELSE x END AS region,
  coalesce(l.toxic, 0)::BIGINT AS toxic FROM (SELECT *, CASE WHEN event_type = 'error' THEN ' '
  WHEN event_type = 'view' THEN NULL ELSE event_type END AS x FROM events) e LEFT JOIN labels l ON l.doc_id = e.event_id""", "PF-16")
def _(t):
    rows = t.events.join(t.labels, F.col("event_id") == F.col("doc_id"), "left").select(
        "event_id", F.when(F.col("event_type") == "error", " ").when(F.col("event_type") == "view", F.lit(None))
        .otherwise(F.col("event_type")).alias("region"), "toxic")
    return filters.fill_default(filters.fill_default(rows, "region", "other"), "toxic", 0)


@query("quality_report", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(value > 1, false)) AS value_above_one,
  count(*) FILTER (WHERE user_id IS NULL) AS user_known FROM events""", "Q-01")
def _(t):
    return quality.quality_report(t.events, {
        "value_above_one": F.col("value") > 1, "user_known": F.col("user_id").isNotNull()})


@query("assert_quality", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS id_known FROM events", "Q-01")
def _(t):
    return quality.assert_quality(t.events, {"id_known": F.col("event_id").isNotNull()})
