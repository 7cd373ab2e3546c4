"""Windows, sorts, dates, bins and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    DAILY, EVENT, KINDS, PANEL, POSTS, SCORE_BIN, STATUS_WEEKS, panel, posts, r, status_weeks,
)
from panelweave.functions import bins, dates
from panelweave.operators import filters, ordering, reshape, spread, windows
from panelweave.plans import panel as panel_plans

DAY = "CAST(day AS VARCHAR) AS day"
WEEK = "CAST(week_start AS VARCHAR) AS week_start"


@query("lag_diff", f"""WITH {DAILY} SELECT entity, {DAY}, lag(n_posts) OVER w AS n_old, {r('prediction - lag(prediction) OVER w')} AS score_diff
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY day)""", "W-01")
def _(t):
    return windows.lag_diff(panel(t, "day"), "entity", "day", {"n_posts": "n_old"}, {"prediction": "score_diff"}).select(
        "entity", "day", "n_old", "score_diff")


@query("lag_diff_max_gap", f"""WITH {DAILY} SELECT entity, {DAY}, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 1
  THEN lag(n_posts) OVER w END AS n_old FROM panel WINDOW w AS (PARTITION BY entity ORDER BY day)""", "W-01")
def _(t):
    return windows.lag_diff(panel(t, "day"), "entity", "day", {"n_posts": "n_old"}, max_gap=1).select("entity", "day", "n_old")


BINNED = DAILY + f", binned AS (SELECT *, {SCORE_BIN} AS score_bin FROM panel)"


def binned(t):
    return panel(t, "day").withColumn("score_bin", bins.score_bin("prediction"))


@query("shift_in_group", f"""WITH {BINNED} SELECT entity, {DAY}, score_bin, bin_old FROM (SELECT *, lag(score_bin) OVER
  (PARTITION BY entity ORDER BY day) AS bin_old FROM binned) WHERE bin_old IS NOT NULL""", "W-02")
def _(t):
    return windows.shift_in_group(binned(t), "entity", "day", "score_bin", "bin_old")


@query("entity_span", f"""WITH {POSTS} SELECT post_id, CAST(min(day) OVER w AS VARCHAR) AS min_date, CAST(max(day) OVER w AS VARCHAR) AS max_date,
  CAST(min(day) OVER w <= DATE '{EVENT}' AND max(day) OVER w >= DATE '{EVENT}' AS BIGINT) AS active_both FROM posts
  WINDOW w AS (PARTITION BY entity)""", "W-03")
def _(t):
    return windows.entity_span(posts(t), "entity", "day", EVENT).select("post_id", "min_date", "max_date", "active_both")


@query("region_week_stats", f"""SELECT c_nationkey::BIGINT AS c_nationkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week_start,
  {r('max(o_totalprice)')} AS top, {r('sum(o_totalprice)', 2)} AS total, {r('avg(o_totalprice)', 4)} AS mean
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""", "W-04")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("week_start", dates.week_start("o_orderdate"))
    out = windows.region_week_stats(rows, ["c_nationkey", "week_start"], {"o_totalprice": "top"}, {"o_totalprice": "total"}, {"o_totalprice": "mean"})
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("share_of", f"WITH {STATUS_WEEKS} SELECT series, {WEEK}, n, {r('n / sum(n) OVER (PARTITION BY week_start)')} AS share, "
       "CAST(sum(n) OVER (PARTITION BY week_start) AS BIGINT) AS tot FROM sw", "W-05")
def _(t):
    return windows.share_of(status_weeks(t).drop("total"), "week_start", "n", total="tot")


@query("trailing_mean", f"""WITH {STATUS_WEEKS} SELECT series, {WEEK}, {r('CASE WHEN count(*) OVER w = 3 THEN avg(n) OVER w END')} AS smooth
  FROM sw WINDOW w AS (PARTITION BY series ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "W-06")
def _(t):
    return windows.trailing_mean(status_weeks(t), "series", "week_start", "n", "smooth").select("series", "week_start", "smooth")


NUMBERED = "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_number FROM events"


@query("number_rows", NUMBERED, "W-07")
def _(t):
    return windows.number_rows(t.events, "event_type", ["ts", "event_id"]).select("event_id", "row_number")


@query("number_rows_spread", NUMBERED, "W-07 large groups")
def _(t):
    return windows.number_rows(t.events, "event_type", ["ts", "event_id"], hot_rows=100).select("event_id", "row_number")


@query("running_total", f"""SELECT event_id, {r('sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 4)} AS total
  FROM events""", "W-07 helper")
def _(t):
    return spread.running_total(t.events, ["event_type"], ["ts", "event_id"], "value", "total").select(
        "event_id", F.round("total", 4).alias("total"))


def cut_sql(table, col, n):
    """Cut points of the averaged rule: the next value, or the mean of two."""
    return f"""o AS (SELECT {col} AS x, row_number() OVER (ORDER BY {col}) AS i, count(*) OVER () AS n FROM {table} WHERE {col} IS NOT NULL),
  cuts AS (SELECT k, CASE WHEN any_value(n) * k % {n} = 0 THEN (max(x) FILTER (WHERE i = n * k // {n}) + max(x) FILTER (WHERE i = n * k // {n} + 1)) / 2
    ELSE max(x) FILTER (WHERE i = n * k // {n} + 1) END AS c FROM o, range(1, {n}) g(k) GROUP BY k)"""


@query("quantile_bin", f"""WITH {cut_sql('lineitem', 'l_extendedprice', 20)} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  1 + (SELECT count(*) FROM cuts WHERE c < l_extendedprice) AS bin FROM lineitem""", "W-08")
def _(t):
    return windows.quantile_bin(t.lineitem, "l_extendedprice", 20).select("l_orderkey", "l_linenumber", "bin")


@query("quantile_bin_ties", f"""WITH {cut_sql('lineitem', 'l_quantity', 100)} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  1 + (SELECT count(*) FROM cuts WHERE c < l_quantity) AS bin FROM lineitem""", "W-08")
def _(t):
    return windows.quantile_bin(t.lineitem, "l_quantity", 100).select("l_orderkey", "l_linenumber", "bin")


@query("bin_means", f"""SELECT event_id, {r('avg(value) OVER (PARTITION BY floor(value / 5))')} AS value_m FROM events""", "W-09")
def _(t):
    rows = t.events.withColumn("bin", F.floor(F.col("value") / 5))
    return windows.bin_means(rows, "bin", {"value": "value_m"}).select("event_id", "value_m")


@query("first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn "
       "FROM orders) WHERE rn = 1", "W-10")
def _(t):
    return windows.first_per_key(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


# sorts and top-k

@query("sort_panel", f"WITH {PANEL} SELECT entity, {WEEK}, n_posts FROM panel ORDER BY entity, week_start", "S-01")
def _(t):
    return ordering.sort_panel(panel(t), "entity", "week_start").select("entity", "week_start", "n_posts")


@query("top_terms", f"""SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM
  (SELECT lang, unnest(string_split(text, ' ')) AS term, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE rank <= 20""", "S-02")
def _(t):
    counts = t.documents.select("lang", F.explode(F.split("text", " ")).alias("term")).groupBy("lang", "term").agg(
        F.count(F.lit(1)).alias("n"))
    return ordering.top_terms(counts, "lang", "term", "n", 20)


@query("order_categories", "SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS \"order\" "
       "FROM events", "S-03")
def _(t):
    return ordering.order_categories(t.events.select("event_id", "event_type"), "event_type", ["view", "click", "purchase"])


@query("arg_best", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", "S-04")
def _(t):
    return ordering.arg_best(t.orders, "o_totalprice", tie=["o_orderkey"]).select("o_orderkey")


@query("head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", "S-05")
def _(t):
    return ordering.head(t.orders, 7, "o_orderkey").select("o_orderkey")


@query("limit_per_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn "
       "FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25') WHERE rn <= 11", "S-06")
def _(t):
    rows = filters.where_date(t.events, "ts", "2024-01-05 00:00:00", "2024-01-25 00:00:00", hi_open=True)
    return ordering.limit_per_group(rows, "user_id", [F.desc("ts"), F.col("event_id")], 11).select("user_id", "event_id")


# dates

@query("to_utc", """SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS utc FROM events""", "D-01")
def _(t):
    return t.events.select("event_id", dates.to_utc(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00"))).alias("utc"))


@query("week_start", "SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week_start FROM orders", "D-02")
def _(t):
    return t.orders.select("o_orderkey", dates.week_start("o_orderdate").alias("week_start"))


@query("week_label", """SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS monday,
  CAST(CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS VARCHAR) AS sunday FROM orders""", "D-03")
def _(t):
    return t.orders.select("o_orderkey", dates.week_label("o_orderdate").alias("monday"), dates.week_label("o_orderdate", "SUN").alias("sunday"))


@query("biweek", f"""WITH {STATUS_WEEKS}, k AS (SELECT week_start, CAST(floor((date_diff('day', min(week_start) OVER (), week_start) // 7 + 1) / 2) AS BIGINT) AS b
  FROM (SELECT DISTINCT week_start FROM sw)), m AS (SELECT b, min(week_start) AS biweek FROM k GROUP BY b)
  SELECT series, CAST(sw.week_start AS VARCHAR) AS week_start, CAST(biweek AS VARCHAR) AS biweek,
  date_diff('day', DATE '1998-02-23', sw.week_start) AS dist, date_diff('day', DATE '1998-02-23', biweek) AS dist_bi,
  month(sw.week_start) AS month, month(sw.week_start) - 2 AS dist_month, date_diff('day', DATE '1998-02-23', sw.week_start) || ' days' AS dist_label, (month(sw.week_start) - 2) || ' months' AS dist_month_label
  FROM sw JOIN k USING (week_start) JOIN m USING (b)""", "D-04 D-05 D-06")
def _(t):
    rows = panel_plans.add_calendar(status_weeks(t), event="1998-02-23")
    return rows.select("series", "week_start", "biweek", "dist", "dist_bi", "month", "dist_month", "dist_label", "dist_month_label")


@query("month_of", "SELECT o_orderkey, month(o_orderdate) AS month, month(o_orderdate) - 2 AS dist_month FROM orders", "D-05")
def _(t):
    return t.orders.select("o_orderkey", dates.month_of("o_orderdate").alias("month"), dates.month_distance("o_orderdate").alias("dist_month"))


@query("event_distance", f"WITH {POSTS} SELECT post_id, date_diff('day', DATE '{EVENT}', week_start) AS dist, "
       f"date_diff('day', DATE '{EVENT}', week_start) || ' days' AS label FROM posts", "D-06")
def _(t):
    d = dates.event_distance("week_start", EVENT)
    return posts(t).select("post_id", d.alias("dist"), dates.distance_label(d).alias("label"))


# bins

@query("cut_right", f"""SELECT event_id, CASE WHEN x <= -1.01 THEN NULL WHEN x <= -0.6 THEN 'far_left' WHEN x <= -0.2 THEN 'center_left'
  WHEN x <= 0.2 THEN 'center' WHEN x <= 0.6 THEN 'center_right' WHEN x <= 1.01 THEN 'far_right' END AS bin,
  CASE WHEN x <= -1.01 THEN NULL WHEN x <= -0.1 THEN 'left' WHEN x <= 0.1 THEN 'center' WHEN x <= 1.01 THEN 'right' END AS leaning
  FROM (SELECT event_id, value / 10 - 1 AS x FROM events)""", "M-01")
def _(t):
    x = F.col("value") / 10 - 1
    return t.events.select("event_id", bins.cut_right(x).alias("bin"), bins.leaning(x).alias("leaning"))


@query("score_bin", f"SELECT event_id, {SCORE_BIN} AS bin FROM (SELECT event_id, value / 10 - 1 AS prediction FROM events)", "M-02")
def _(t):
    return t.events.select("event_id", bins.score_bin(F.col("value") / 10 - 1).alias("bin"))


@query("powers_and_bands", f"""SELECT event_id, {r('value', 1)} AS rounded, {r('value ** 2', 4)} AS p2, {r('value ** 3', 4)} AS p3,
  {r('value - 1.96 * 0.3', 4)} AS ll, {r('value + 1.96 * 0.3', 4)} AS ul FROM events""", "M-03")
def _(t):
    p2, p3 = bins.powers("value", 3)
    ll, ul = bins.ci_band("value", F.lit(0.3))
    return t.events.select("event_id", bins.round_to("value", 1).alias("rounded"), *[
        F.round(c, 4).alias(n) for c, n in ((p2, "p2"), (p3, "p3"), (ll, "ll"), (ul, "ul"))])


# reshaping

@query("one_hot", "SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END AS {k}" for k in KINDS) + " FROM events", "R-01")
def _(t):
    return reshape.one_hot(t.events, "event_type", KINDS).select("event_id", *KINDS)


@query("to_long", f"WITH {PANEL} " + " UNION ALL ".join(
    f"SELECT entity, {WEEK}, '{k}' AS variable, {k} AS value FROM panel" for k in KINDS), "R-02")
def _(t):
    return reshape.to_long(panel(t), ["entity", "week_start"], KINDS)


@query("to_wide", f"WITH {STATUS_WEEKS} SELECT {WEEK}, " + ", ".join(f"max(n) FILTER (WHERE series = '{s}') AS {s}" for s in "FOP")
       + " FROM sw GROUP BY week_start", "R-03")
def _(t):
    return reshape.to_wide(status_weeks(t), "week_start", "series", list("FOP"), "n")


@query("transpose", """WITH c AS (SELECT o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT p AS variable, max(n) FILTER (WHERE s = 'F') AS F, max(n) FILTER (WHERE s = 'O') AS O, max(n) FILTER (WHERE s = 'P') AS P FROM c GROUP BY 1""", "R-03")
def _(t):
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("s"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    wide = reshape.to_wide(counts, "s", "p", list("12345"), "n")
    return reshape.transpose(wide, "s", list("12345"), list("FOP"))


@query("encode_labels", """WITH l AS (SELECT lang AS x FROM documents UNION SELECT source FROM documents),
  c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM l)
  SELECT doc_id, a.code AS lang_enc, b.code AS source_enc FROM documents JOIN c a ON a.x = lang JOIN c b ON b.x = source""", "R-04")
def _(t):
    return reshape.encode_labels(t.documents, ["lang", "source"]).select("doc_id", "lang_enc", "source_enc")
