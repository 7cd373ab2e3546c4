"""Statistics: regressions, correlations, curves, class reports, detrending."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import CLASSES, DAILY, EVENT, KINDS, STATUS_WEEKS, classes, panel, r, status_weeks
from catalog.window_queries import cut_sql
from panelweave.functions import dates
from panelweave.operators import decompose, eventstudy, filters, reshape, stats

ITEM = "li AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_quantity * 1.4 AS yhat, l_returnflag AS g FROM lineitem)"


def item(t):
    return t.lineitem.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
                             (F.col("l_quantity") * 1.4).alias("yhat"), F.col("l_returnflag").alias("g"))


@query("regression_metrics", f"""WITH {ITEM} SELECT g, count(*) AS n, {r('avg(abs(y - yhat))')} AS MAE, {r('avg((y - yhat) ** 2)')} AS MSE,
  {r('1 - (regr_syy(y, yhat) - regr_sxy(y, yhat) ** 2 / regr_sxx(y, yhat)) / sum(y * y)')} AS R2 FROM li GROUP BY g""", "ST-01")
def _(t):
    return stats.regression_metrics(item(t), "y", "yhat", "g")


@query("ols_simple", f"""WITH {ITEM} SELECT g, count(*) AS n, {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept,
  {r('sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x))')} AS se FROM li GROUP BY g""", "ST-02")
def _(t):
    return stats.ols_simple(item(t), "x", "y", "g")


# Cubic fit by successive orthogonal directions 1, u1, u2, u3.
def cubic_sql(source, x="x", y="y"):
    return f"""k0 AS (SELECT {x} AS x, {y} AS y, {x} - (SELECT avg({x}) FROM {source}) AS u1 FROM {source}),
  k1 AS (SELECT *, x * x - (SELECT avg(x * x) FROM k0) - u1 * (SELECT sum(x * x * u1) / sum(u1 * u1) FROM k0) AS u2 FROM k0),
  k2 AS (SELECT *, x ** 3 - (SELECT avg(x ** 3) FROM k1) - u1 * (SELECT sum(x ** 3 * u1) / sum(u1 * u1) FROM k1)
    - u2 * (SELECT sum(x ** 3 * u2) / sum(u2 * u2) FROM k1) AS u3 FROM k1),
  fit AS (SELECT x, y, (SELECT avg(y) FROM k2) + u1 * (SELECT sum(y * u1) / sum(u1 * u1) FROM k2)
    + u2 * (SELECT sum(y * u2) / sum(u2 * u2) FROM k2) + u3 * (SELECT sum(y * u3) / sum(u3 * u3) FROM k2) AS yhat FROM k2)"""


CUBE = "src AS (SELECT event_id, value / 20 - 1 AS x, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + value / 50 AS y FROM events)"


def cube(t):
    x = F.col("value") / 20 - 1
    return t.events.select("event_id", x.alias("x"), F.pow(x, F.lit(2.0)).alias("x2"), F.pow(x, F.lit(3.0)).alias("x3"),
                           (F.when(F.col("event_type") == "click", 1.0).otherwise(0.0) + F.col("value") / 50).alias("y"))


@query("ols_cubic_fit", f"WITH {CUBE}, {cubic_sql('src')} SELECT {r('x')} AS x, {r('y')} AS y, {r('yhat')} AS yhat FROM fit", "ST-03")
def _(t):
    rows = cube(t)
    return stats.ols_predict(rows, stats.ols(rows, ["x", "x2", "x3"], "y")).select("x", "y", "yhat")


@query("ols_hc1", f"""WITH {ITEM}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, regr_sxx(y, x) AS sxx, count(*) AS n FROM li),
  e AS (SELECT x, y - a - b * x AS e, m, sxx, n FROM li, f)
  SELECT 'x' AS term, {r('any_value(b)')} AS b, {r('sqrt(sum((x - e.m) ** 2 * e * e) / any_value(e.sxx) ** 2 * any_value(e.n) / (any_value(e.n) - 2))')} AS se FROM e, f
  UNION ALL SELECT 'const', {r('any_value(a)')}, {r('sqrt(sum((1.0 / e.n - (x - e.m) * e.m / e.sxx) ** 2 * e * e) * any_value(e.n) / (any_value(e.n) - 2))')} FROM e, f""", "ST-03")
def _(t):
    return stats.ols_table(item(t), ["x"], "y", "HC1")


@query("binscatter", f"""WITH {cut_sql('lineitem', 'l_extendedprice', 20)}, b AS (SELECT l_extendedprice, l_quantity,
  1 + (SELECT count(*) FROM cuts WHERE c < l_extendedprice) AS bin FROM lineitem)
  SELECT bin, count(*) AS n, {r('avg(l_extendedprice)', 4)} AS x_mean, {r('avg(l_quantity)')} AS y_mean FROM b GROUP BY 1""", "ST-05 W-08 W-09")
def _(t):
    return stats.binscatter(t.lineitem, "l_extendedprice", "l_quantity").withColumn("x_mean", F.round("x_mean", 4))


@query("within_percentiles", f"""WITH {cut_sql('orders', 'o_totalprice', 100)} SELECT o_orderkey FROM orders
  WHERE o_totalprice > (SELECT c FROM cuts WHERE k = 1) AND o_totalprice <= (SELECT c FROM cuts WHERE k = 99)""", "ST-05")
def _(t):
    return stats.within_percentiles(t.orders, "o_totalprice").select("o_orderkey")


@query("corr_pearson", f"SELECT {r('corr(l_quantity, l_extendedprice)')} AS rho FROM lineitem", "ST-06")
def _(t):
    return stats.corr_pair(t.lineitem, "l_quantity", "l_extendedprice")


@query("corr_spearman", f"""WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
  SELECT {r('corr(a, b)')} AS rho FROM k""", "ST-06")
def _(t):
    return stats.corr_pair(t.lineitem, "l_quantity", "l_extendedprice", "spearman")


COLS = ["l_quantity", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS rho FROM lineitem" for a in COLS for b in COLS), "ST-06")
def _(t):
    return stats.corr_matrix(t.lineitem, COLS)


RANKED = f"""WITH {STATUS_WEEKS}, w AS (SELECT week_start, max(n) FILTER (WHERE series = 'F') AS F, max(n) FILTER (WHERE series = 'O') AS O,
  max(n) FILTER (WHERE series = 'P') AS P FROM sw GROUP BY 1), k AS (SELECT """ + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in "FOP") + \
    " FROM w WHERE F IS NOT NULL AND O IS NOT NULL AND P IS NOT NULL) "


@query("corr_matrix_spearman", RANKED + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS rho FROM k" for a in "FOP" for b in "FOP"), "ST-06")
def _(t):
    wide = reshape.to_wide(status_weeks(t), "week_start", "series", list("FOP"), "n").dropna()
    return stats.corr_matrix(wide, list("FOP"), "spearman")


LONG_RANKED = "WITH k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in COLS) + " FROM lineitem) "


@query("corr_matrix_spearman_rows", LONG_RANKED + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS rho FROM k" for a in COLS for b in COLS), "ST-06")
def _(t):
    return stats.corr_matrix(t.lineitem.select(*COLS), COLS, "spearman")


@query("detrend_moving", f"""WITH {STATUS_WEEKS}, f AS (SELECT series, week_start, n - avg(n) OVER (PARTITION BY series ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS flat,
  (row_number() OVER (PARTITION BY series ORDER BY week_start) - 1) % 2 AS phase FROM sw)
  SELECT series, CAST(week_start AS VARCHAR) AS week_start, {r('flat - avg(flat) OVER (PARTITION BY series, phase)')} AS resid FROM f""", "ST-07")
def _(t):
    return decompose.detrend_moving(status_weeks(t), "series", "week_start", "n")


@query("detrend_residual", None, "ST-07")
def _(t):
    return decompose.detrend_residual(status_weeks(t), "series", "week_start", "n")


PER = """c AS (SELECT k AS class, count(*) FILTER (WHERE y = k) AS support, count(*) FILTER (WHERE yhat = k) AS said,
  count(*) FILTER (WHERE y = k AND yhat = k) AS hit FROM cls, (SELECT DISTINCT y AS k FROM cls) GROUP BY k),
  s AS (SELECT class, support, CASE WHEN said = 0 THEN 0.0 ELSE hit / said END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS recall,
  2 * hit / (said + support) AS f1 FROM c)"""


@query("class_scores", f"WITH {CLASSES}, {PER} SELECT class, support, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM s", "ST-08")
def _(t):
    return stats.class_scores(classes(t), "y", "yhat")


@query("classification_report", f"""WITH {CLASSES}, {PER} SELECT {r('avg(f1)')} AS f1, {r('max(f1) - min(f1)')} AS f1_gap,
  {r('(SELECT avg(CASE WHEN y = yhat THEN 1 ELSE 0 END) FROM cls)')} AS acc, {r('avg(precision)')} AS prec, {r('avg(recall)')} AS recall FROM s""", "ST-08")
def _(t):
    return stats.classification_report(classes(t), "y", "yhat")


@query("confusion", f"WITH {CLASSES} SELECT y AS actual, " + ", ".join(
    f"count(*) FILTER (WHERE yhat = '{k}') AS {k}" for k in KINDS) + " FROM cls GROUP BY 1", "ST-08")
def _(t):
    return stats.confusion(classes(t), "y", "yhat", KINDS)


def study_panel(t):
    rows = panel(t, "day").withColumn("dist", dates.event_distance("day", EVENT))
    for k in ("click", "purchase"):
        rows = filters.with_rate(rows, k, "n_posts", k)
    return rows


@query("event_study", None, "ST-04")
def _(t):
    return eventstudy.event_study(study_panel(t), ["click", "purchase", "prediction"], "dist", "entity")


# With two periods the estimate has a closed form: the slope of the demeaned
# outcome on the demeaned "after" flag, with scores summed per entity.
@query("event_study_before_after", f"""WITH {DAILY}, d AS (SELECT entity, prediction AS y, CASE WHEN day >= DATE '{EVENT}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x,
   count(*) OVER (PARTITION BY entity) AS n FROM panel),
  k AS (SELECT entity, x - avg(x) OVER (PARTITION BY entity) AS dx, y - avg(y) OVER (PARTITION BY entity) AS dy FROM d WHERE n > 1),
  f AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS sxx, count(*) AS n, count(DISTINCT entity) AS g FROM k),
  u AS (SELECT entity, sum(dx * (dy - b * dx)) AS u FROM k, f GROUP BY entity)
  SELECT {r('b')} AS b, {r('sqrt(sum(u * u) * g / (g - 1) * (n - 1) / (n - 2)) / sxx')} AS se, n, g AS clusters FROM u, f GROUP BY f.b, sxx, n, g""", "ST-04")
def _(t):
    rows = panel(t, "day").withColumn("dist", F.when(F.col("day") >= F.lit(EVENT).cast("date"), 0).otherwise(-7))
    out = eventstudy.event_study(rows, "prediction", "dist", "entity")
    return out.where("dist = 0").select("b", "se", "n", "clusters")
