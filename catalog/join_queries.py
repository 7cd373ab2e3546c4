"""Joins, set operations and list lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    LABELS, LINKED, LINKS, PANEL, POSTS, domain_scores, linked_posts, links, panel, posts, r,
)
from panelweave.functions import dates, text, urls
from panelweave.operators import joins, sets

WEEK = "CAST(week_start AS VARCHAR) AS week_start"


@query("join_entity_week", f"""WITH {PANEL} SELECT p.post_id, CAST(p.week_start AS VARCHAR) AS week_start, a.n_posts
  FROM posts p LEFT JOIN (SELECT * FROM panel WHERE n_posts > 5) a USING (week_start, entity)""", "J-01")
def _(t):
    return joins.join_entity_week(posts(t), panel(t).where("n_posts > 5").select("week_start", "entity", "n_posts")).select(
        "post_id", "week_start", "n_posts")


@query("join_attrs", """WITH first_order AS (SELECT o_custkey, o_orderpriority FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1)
  SELECT c_custkey, c_mktsegment, o_orderpriority FROM customer LEFT JOIN first_order ON o_custkey = c_custkey""", "J-02")
def _(t):
    attrs = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return joins.join_attrs(t.customer, attrs, "c_custkey", ["o_orderkey"]).select(
        "c_custkey", "c_mktsegment", "o_orderpriority")


@query("join_dim", "SELECT c_custkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM customer "
       "LEFT JOIN nation ON n_nationkey = c_nationkey", "J-03")
def _(t):
    return joins.join_dim(t.customer, t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select(
        "c_custkey", "n_name", "n_regionkey")


@query("join_inner", "SELECT doc_id, source, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id)", "J-04")
def _(t):
    return joins.join_inner(t.documents, t.labels, "doc_id", "1:1").select("doc_id", "source", "quality")


@query("join_outer_indicator", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only'
  WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS _merge
  FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT CASE WHEN quality = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id FROM labels) l ON d.doc_id = l.doc_id""", "J-05")
def _(t):
    # labels of low quality get ids that no document has
    ids = t.labels.select(F.when(F.col("quality") == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"))
    return joins.join_outer_indicator(t.documents.select("doc_id"), ids, "doc_id").select("doc_id", "_merge")


@query("keep_present", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer "
       "WHERE c_mktsegment = 'BUILDING')", "J-06")
def _(t):
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return joins.keep_present(t.events, ids, "user_id").select("event_id")


@query("pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "J-07")
def _(t):
    return joins.pending(t.documents, t.labels, "doc_id").select("doc_id")


LOOKED = f"""WITH {LINKED}, {LINKS}, long AS (SELECT post_id, unnest(list) AS url, unnest(range(len(list))) AS pos
  FROM (SELECT post_id, regexp_extract_all(text, 'https?://[^\\s]+') AS list FROM linked))"""


@query("lookup_list", LOOKED + """ SELECT p.post_id, coalesce(g.locations, '') AS locations FROM posts p LEFT JOIN
  (SELECT post_id, string_agg(location, ' ' ORDER BY pos) AS locations FROM long JOIN links USING (url)
   WHERE location IS NOT NULL GROUP BY post_id) g USING (post_id)""", "J-08")
def _(t):
    rows = linked_posts(t).select("post_id", text.extract_urls("text").alias("urls"))
    out = joins.lookup_list(rows, "urls", links(t), "url", "location", "locations", "post_id")
    return out.select("post_id", F.array_join("locations", " ").alias("locations"))


@query("lookup_list_split", LOOKED + """ SELECT post_id, pos, location FROM long JOIN links USING (url)
  WHERE location IS NOT NULL""", "J-08")
def _(t):
    rows = linked_posts(t).select("post_id", F.posexplode(text.extract_urls("text")).alias("pos", "url"))
    # every key above 20 rows counts as hot here, so the split path is taken
    return joins.lookup_long(rows, "url", links(t), "url", "location", hot_rows=20).select("post_id", "pos", "location")


@query("lookup_dim", f"""WITH {LINKED}, {LABELS}, long AS (SELECT post_id, regexp_extract(u, '([a-z]+\\.(com|org|net|test))(/|$)', 1) AS domain, pos
  FROM (SELECT post_id, unnest(list) AS u, unnest(range(len(list))) AS pos FROM
    (SELECT post_id, regexp_extract_all(text, 'https?://[^\\s/]+') AS list FROM linked)))
  SELECT p.post_id, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total FROM posts p LEFT JOIN
   (SELECT post_id, count(*) AS n, sum(score) AS total FROM long JOIN labels_dim USING (domain) GROUP BY 1) USING (post_id)""", "J-09 AR-02")
def _(t):
    from panelweave.functions import arrays
    rows = linked_posts(t).select("post_id", F.transform(
        text.extract_urls("text"), lambda u: urls.registered_domain(u)).alias("domains"))
    out = joins.lookup_dim(rows, "domains", domain_scores(t), "domain", "score", "scores", "post_id")
    return out.select("post_id", arrays.list_len("scores").cast("bigint").alias("n"), arrays.list_sum("scores").alias("total"))


@query("range_join", f"""WITH {POSTS}, b AS (SELECT min(week_start) AS lb, max(week_start) AS ub FROM (SELECT DISTINCT week_start,
  floor((date_diff('day', (SELECT min(week_start) FROM posts), week_start) / 7 + 1) / 2) AS k FROM posts) GROUP BY k)
  SELECT post_id, CAST(lb AS VARCHAR) AS biweek FROM posts LEFT JOIN b ON week_start BETWEEN lb AND ub""", "J-10")
def _(t):
    rows = posts(t)
    first = F.broadcast(rows.agg(F.min("week_start").alias("first")))
    bounds = (rows.select("week_start").distinct().crossJoin(first)
              .groupBy(dates.biweek_index("week_start", "first").alias("k"))
              .agg(F.min("week_start").alias("lb"), F.max("week_start").alias("ub")))
    return joins.range_join(rows, bounds, "week_start").select("post_id", F.col("lb").alias("biweek"))


@query("balance_panel_topics", f"""WITH {POSTS}, c AS (SELECT topic, day, count(*) AS n FROM posts GROUP BY 1, 2)
  SELECT e.topic, CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic FROM c) e
  CROSS JOIN (SELECT DISTINCT day FROM c) d LEFT JOIN c ON c.topic = e.topic AND c.day = d.day""", "J-11")
def _(t):
    counts = posts(t).groupBy("topic", "day").agg(F.count(F.lit(1)).alias("n"))
    return joins.balance_panel(counts, "topic", "day")


@query("balance_panel", f"""WITH {POSTS}, c AS (SELECT entity, day, count(*) AS n FROM posts GROUP BY 1, 2)
  SELECT e.entity, CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM (SELECT DISTINCT entity FROM c) e
  CROSS JOIN (SELECT DISTINCT day FROM c) d LEFT JOIN c ON c.entity = e.entity AND c.day = d.day""", "J-11")
def _(t):
    counts = posts(t).groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"))
    return joins.balance_panel(counts, "entity", "day")


@query("attach_by_id", f"""WITH {POSTS}, a AS (SELECT entity, day, count(*) AS clicks FROM posts WHERE topic = 'click' GROUP BY 1, 2),
  b AS (SELECT entity, day, count(*) AS others FROM posts WHERE topic <> 'click' GROUP BY 1, 2)
  SELECT coalesce(a.entity, b.entity) AS entity, CAST(coalesce(a.day, b.day) AS VARCHAR) AS day, clicks, others FROM a FULL JOIN b ON a.day = b.day AND a.entity = b.entity""", "J-12")
def _(t):
    p = posts(t)
    a = p.where("topic = 'click'").groupBy("entity", "day").agg(F.count(F.lit(1)).alias("clicks"))
    b = p.where("topic <> 'click'").groupBy("entity", "day").agg(F.count(F.lit(1)).alias("others"))
    return joins.attach_by_id(a, b, ["entity", "day"])


@query("checked_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey", "J-13")
def _(t):
    dim = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.checked_join(t.orders, dim, "o_custkey", "inner", "m:1").select("o_orderkey", "c_name")


@query("merge_dicts", """WITH o AS (SELECT doc_id, lang AS v FROM documents), n AS (SELECT doc_id * 2 AS doc_id, 'new' AS v FROM labels)
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.v, n.v) AS v FROM o FULL JOIN n ON o.doc_id = n.doc_id""", "J-14")
def _(t):
    old = t.documents.select("doc_id", F.col("lang").alias("v"))
    new = t.labels.select((F.col("doc_id") * 2).alias("doc_id"), F.lit("new").alias("v"))
    return joins.merge_dicts(new, old, "doc_id")


@query("merge_batches", f"SELECT user_id, arg_max(event_type, event_id) AS event_type, {r('arg_max(value, event_id)')} AS value "
       "FROM events GROUP BY 1", "J-14")
def _(t):
    return joins.merge_batches(t.events.select("user_id", "event_type", "value", "event_id"), "user_id", "event_id").drop("event_id")


@query("salted_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id", "J-08 skew path")
def _(t):
    side = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return joins.salted_join(t.events, side, "user_id", hot_rows=50).select("event_id", "c_mktsegment")


# set operations

@query("union_all", "SELECT doc_id, lang, NULL::BIGINT AS quality FROM documents UNION ALL "
       "SELECT doc_id, NULL, quality::BIGINT FROM labels", "U-01")
def _(t):
    return sets.union_all(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", F.col("quality").cast("bigint")))


@query("union_ids", "SELECT doc_id AS id FROM documents UNION SELECT user_id FROM events", "U-02")
def _(t):
    return sets.union_ids(t.documents.select(F.col("doc_id").alias("id")), t.events.select(F.col("user_id").alias("id")))


@query("minus", "SELECT doc_id AS id FROM documents EXCEPT SELECT user_id FROM events", "U-03")
def _(t):
    return sets.minus(t.documents.select(F.col("doc_id").alias("id")), t.events.select(F.col("user_id").alias("id")))


@query("overlaps", "SELECT doc_id, CAST(list_has_any(string_split(lower(text), ' '), ['the', 'der', 'que']) AS BIGINT) AS hit FROM documents", "U-04")
def _(t):
    words = F.split(F.lower("text"), " ")
    return t.documents.select("doc_id", sets.overlaps(words, F.array(*[F.lit(w) for w in ("the", "der", "que")])).alias("hit"))


@query("common", "SELECT doc_id AS id FROM documents INTERSECT SELECT user_id FROM events", "U-04")
def _(t):
    return sets.common(t.documents.select(F.col("doc_id").alias("id")), t.events.select(F.col("user_id").alias("id")))


@query("split_by", """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'met' ELSE 'other' END AS part
  FROM documents d LEFT JOIN labels USING (doc_id)""", "U-05")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")
    met, other = sets.split_by(rows, F.col("quality") == 1)
    return met.select("doc_id", F.lit("met").alias("part")).unionByName(other.select("doc_id", F.lit("other").alias("part")))
