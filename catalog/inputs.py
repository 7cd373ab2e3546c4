"""Stand-ins for the analytic inputs, each derived from the given tables, and
the same derivations as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave import fixed
from panelweave.functions import dates
from panelweave.sources.readers import widen

# category -> score and category -> emotion stand-in
SCORES = {"view": -1.0, "signup": -0.5, "error": 0.0, "click": 0.5, "purchase": 1.0}
KINDS = ["click", "error", "purchase", "signup", "view"]
EVENT = "2024-01-15"
DOMAIN_SCORES = [("example.com", 0.5), ("example.org", -1.0), ("example.net", 0.0)]
HOST_SUFFIXES = ("example.com", "example.net", "example.org")
STOP = ("the", "and", "of", "le", "la", "de", "und", "der", "el", "que")


def r(expr, digits=6):
    """Rounded, and never a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def score_of(col):
    c = F.col(col)
    out = None
    for k, v in SCORES.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


SCORE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in SCORES.items()) + " END"


def posts(t):
    return t.events.select(
        F.col("event_id").alias("post_id"), "ts", F.col("user_id").alias("entity"),
        F.col("event_type").alias("topic"), "value", score_of("event_type").alias("score"),
        dates.week_start("ts").alias("week_start"), F.to_date("ts").alias("day"))


POSTS = f"""posts AS (SELECT event_id AS post_id, ts, user_id AS entity, event_type AS topic, value,
  {SCORE_CASE} AS score, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(ts AS DATE) AS day FROM events)"""


def panel(t, time="week_start"):
    """Entity-week (or entity-day) table with a prediction and counts."""
    return posts(t).groupBy("entity", time).agg(
        F.avg("score").alias("prediction"), F.count(F.lit(1)).alias("n_posts"),
        *[F.sum(F.when(F.col("topic") == k, 1).otherwise(0)).alias(k) for k in KINDS])


def panel_sql(time="week_start", name="panel"):
    kinds = ", ".join(f"CAST(sum(CASE WHEN topic = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in KINDS)
    return f"""{name} AS (SELECT entity, {time}, avg(score) AS prediction, count(*) AS n_posts, {kinds}
  FROM posts GROUP BY entity, {time})"""


PANEL = POSTS + ",\n" + panel_sql()
DAILY = POSTS + ",\n" + panel_sql("day")

SCORE_BIN = """CASE WHEN prediction < -0.5 THEN 'far_left' WHEN prediction < -0.1 THEN 'center_left'
  WHEN prediction <= 0.1 THEN 'center' WHEN prediction <= 0.5 THEN 'center_right' ELSE 'far_right' END"""


def linked_posts(t):
    """Posts with links in their text: one hit, a hit and a miss, or two hits."""
    n = t.pages.agg(F.count(F.lit(1)).alias("n"))
    url = F.col("url")
    text = (F.when(F.col("post_id") % 3 == 0, F.concat(F.lit("see "), url, F.lit(" end")))
            .when(F.col("post_id") % 3 == 1, F.concat(F.lit("see "), url, F.lit(" and http://nowhere.test/x?id=1 end")))
            .otherwise(F.concat(url, F.lit("\t"), url)))
    return (widen(posts(t), "post_id").crossJoin(F.broadcast(n)).withColumn("page_id", F.col("post_id") % F.col("n"))
            .join(t.pages.select("page_id", "url"), "page_id").withColumn("text", text)
            .drop("n", "url", "page_id", "score"))


LINKED = POSTS + """,
linked AS (SELECT p.post_id, p.ts, p.entity, p.topic, p.value, p.week_start,
  CASE WHEN p.post_id % 3 = 0 THEN 'see ' || g.url || ' end'
       WHEN p.post_id % 3 = 1 THEN 'see ' || g.url || ' and http://nowhere.test/x?id=1 end'
       ELSE g.url || chr(9) || g.url END AS text
  FROM posts p JOIN pages g ON g.page_id = p.post_id % (SELECT count(*) FROM pages))"""


def links(t):
    """Resolved links, some without a location and some failed."""
    return t.pages.select("url", F.when(F.col("page_id") % 7 == 0, F.lit(None))
                          .when(F.col("page_id") % 11 == 0, "Error").otherwise(F.col("url")).alias("location"))


LINKS = """links AS (SELECT url, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 'Error'
  ELSE url END AS location FROM pages)"""


def domain_scores(t):
    return t.spark.createDataFrame(DOMAIN_SCORES, "domain string, score double")


LABELS = "labels_dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{d}', CAST({s} AS DOUBLE))" for d, s in DOMAIN_SCORES) + ") v(domain, score))"


def tagged(t):
    """Pages with their links written as tags, dated and given an entity."""
    return t.pages.select(
        F.col("page_id").alias("post_id"), F.regexp_replace("html", 'href="/', "#").alias("text"),
        (F.col("page_id") % 20).alias("entity"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).alias("day"),
        F.when(F.col("page_id") % 3 == 0, "left").when(F.col("page_id") % 3 == 1, "center")
        .otherwise("right").alias("category"))


TAGGED = """tagged AS (SELECT page_id AS post_id, regexp_replace(html, 'href="/', '#', 'g') AS text,
  page_id % 20 AS entity, CAST(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER) AS DATE) AS day,
  CASE WHEN page_id % 3 = 0 THEN 'left' WHEN page_id % 3 = 1 THEN 'center' ELSE 'right' END AS category FROM pages)"""
KEYWORDS_RE = f"({'|'.join(fixed.TAG_KEYWORDS)})"
TAGS = TAGGED + f""",
tags AS (SELECT post_id, entity, day, category, regexp_extract_all(
  regexp_replace(lower(text), '{KEYWORDS_RE}', '', 'g'), '#[A-Za-z]+[A-Za-z0-9\\-_]+') AS tags FROM tagged)"""

# tag groups that fit the given pages, in the form of the fixed groups
GROUPS = {
    "th-words": ({"all": ("^#th", "e")}, {"all": ("tion$",)}),
    "un-words": ({"all": ("un|en",), "no": "^#th"},),
    "for-of": ({"all": ("for|of",)},),
}
GROUP_SQL = {
    "th-words": "((regexp_matches(x, '^#th') AND regexp_matches(x, 'e')) OR regexp_matches(x, 'tion$'))",
    "un-words": "(regexp_matches(x, 'un|en') AND NOT regexp_matches(x, '^#th'))",
    "for-of": "regexp_matches(x, 'for|of')",
}


def edges(t):
    """Directed tag edges of the pages."""
    from panelweave.functions import text
    from panelweave.operators import graph
    rows = tagged(t).withColumn("tags", text.extract_tags("text"))
    return graph.cooccurrence_edges(rows, "tags", "category")


EDGES = TAGS + """,
edges AS (SELECT l[i] AS src, l[i + 1] AS dst FROM
  (SELECT list_append(tags, category) AS l, unnest(range(1, len(tags) + 1)) AS i FROM tags))"""


def tokens(t):
    """Documents with their lower-case word lists."""
    from panelweave.functions import text
    return t.documents.select("doc_id", "lang", "source", "text", text.tokenize("text", STOP).alias("tokens"))


TOKENS = """tok AS (SELECT doc_id, lang, source, text, list_filter(
  regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}_]+'),
  lambda w: length(w) BETWEEN 3 AND 15 AND NOT starts_with(w, '_') AND w NOT IN (""" + ", ".join(
    f"'{w}'" for w in STOP) + """)) AS tokens FROM documents)"""


def status_weeks(t):
    """Weekly order counts per status, three long series."""
    return t.orders.groupBy(dates.week_start("o_orderdate").alias("week_start"),
                            F.col("o_orderstatus").alias("series")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


STATUS_WEEKS = """sw AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
  o_orderstatus AS series, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)"""


def classes(t):
    """Actual and predicted class per event."""
    return t.events.select("event_id", F.col("event_type").alias("y"), F.when(
        F.col("value") < 5, F.col("event_type")).when(F.col("value") < 10, "click").otherwise("view").alias("yhat"))


CLASSES = """cls AS (SELECT event_id, event_type AS y, CASE WHEN value < 5 THEN event_type
  WHEN value < 10 THEN 'click' ELSE 'view' END AS yhat FROM events)"""
