"""Graph measures on the tag edges of the pages and on daily transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import EDGES, edges, r, status_weeks, tagged
from catalog.stats_queries import RANKED
from catalog.window_queries import BINNED, binned
from panelweave import fixed
from panelweave.operators import graph, reshape, stats

SYM = EDGES + """, sym AS (SELECT DISTINCT node, neighbor FROM (SELECT src AS node, dst AS neighbor FROM edges
  UNION ALL SELECT dst, src FROM edges) WHERE node <> neighbor)"""
LABELS = ["left", "center", "right"]


@query("cooccurrence_edges", f"WITH {EDGES} SELECT src, dst FROM edges", "G-01 AR-05 AR-06")
def _(t):
    return edges(t)


STEPS = BINNED + """, steps AS (SELECT old AS src, score_bin AS dst FROM (SELECT score_bin, lag(score_bin) OVER
  (PARTITION BY entity ORDER BY day) AS old FROM binned) WHERE old IS NOT NULL)"""


@query("transition_edges", f"WITH {STEPS} SELECT src, dst, count(*) AS weight FROM steps GROUP BY 1, 2", "G-02")
def _(t):
    return graph.weigh(graph.transition_edges(binned(t), "entity", "day", "score_bin"))


@query("transition_matrix", f"WITH {STEPS}, s AS (SELECT unnest({list(fixed.BIN_LABELS) + ['unseen']}) AS x) SELECT a.x AS src, b.x AS dst, "
       "count(steps.src) AS weight FROM s a CROSS JOIN s b LEFT JOIN steps ON src = a.x AND dst = b.x GROUP BY 1, 2", "G-02")
def _(t):
    steps = graph.transition_edges(binned(t), "entity", "day", "score_bin")
    return graph.transition_matrix(steps, [*fixed.BIN_LABELS, "unseen"])


@query("degree_distribution", f"WITH {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) "
       "GROUP BY 1) SELECT degree, count(*) AS n_nodes FROM d GROUP BY 1", "G-03")
def _(t):
    return graph.degree_distribution(edges(t))


@query("in_degree_distribution", f"WITH {EDGES}, d AS (SELECT n.node, count(e.dst) AS degree FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n "
       "LEFT JOIN edges e ON e.dst = n.node GROUP BY 1) SELECT degree, count(*) AS n_nodes FROM d GROUP BY 1", "G-03")
def _(t):
    return graph.degree_distribution(edges(t), "in")


@query("degree_centrality", f"WITH {SYM} SELECT node, {r('count(*) / ((SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) - 1)')} AS centrality "
       "FROM sym GROUP BY 1", "G-03")
def _(t):
    return graph.degree_centrality(edges(t))


@query("neighbors", f"WITH {SYM} SELECT node, count(*) AS n_neighbors FROM sym GROUP BY 1", "G-04")
def _(t):
    return graph.neighbors(edges(t))


@query("neighbor_list", f"WITH {SYM} SELECT node, neighbor FROM sym", "G-04")
def _(t):
    return graph.symmetric(edges(t))


ORDER = {"left": -1.0, "right": 1.0}


@query("neighbor_overlap", f"""WITH {SYM}, l AS (SELECT unnest({LABELS}) AS x), n AS (SELECT x, count(neighbor) AS n FROM l LEFT JOIN sym ON node = x GROUP BY 1),
  c AS (SELECT a.x AS orig, b.x AS direc, (SELECT count(*) FROM sym p JOIN sym q ON p.neighbor = q.neighbor WHERE p.node = a.x AND q.node = b.x) AS comm FROM l a, l b WHERE a.x <> b.x),
  act AS (SELECT category AS x, count(*) AS k FROM tagged GROUP BY 1)
  SELECT orig, direc, comm, a.n AS n_nodes1, b.n AS n_nodes2, {r('comm / a.n')} AS perc, {r('comm / (a.n + b.n - 2 - comm)')} AS nover,
  {r('comm / a.n * (a.n / b.n)')} AS perc2, p.k AS n_orig, q.k AS n_direc, {r('a.n / p.k')} AS prov, {r('b.n / q.k')} AS prov2,
  {r('(b.n / q.k) / (a.n / p.k)')} AS perc_act, CASE direc WHEN 'left' THEN -1.0 WHEN 'right' THEN 1.0 ELSE 0.0 END::DOUBLE AS "order"
  FROM c JOIN n a ON a.x = orig JOIN n b ON b.x = direc JOIN act p ON p.x = orig JOIN act q ON q.x = direc""", "G-05")
def _(t):
    active = graph.label_activity(tagged(t), F.array("category"), LABELS)
    return graph.neighbor_overlap(edges(t), LABELS, active, ORDER)


@query("clustering_coefficient", f"""WITH {SYM}, d AS (SELECT node, count(*) AS n FROM sym GROUP BY 1),
  tri AS (SELECT a.node, count(*) AS k FROM sym a JOIN sym b ON a.node = b.node AND a.neighbor < b.neighbor
   JOIN sym c ON c.node = a.neighbor AND c.neighbor = b.neighbor GROUP BY 1)
  SELECT node, n AS n_neighbors, coalesce(k, 0) AS n_triangles, {r('CASE WHEN n < 2 THEN 0.0 ELSE 2 * coalesce(k, 0) / (n * (n - 1)) END')} AS coefficient
  FROM d LEFT JOIN tri USING (node)""", "G-06")
def _(t):
    return graph.clustering_coefficient(edges(t))


@query("graph_summary", f"""WITH {EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), s AS (SELECT node,
  (SELECT count(*) FROM edges WHERE dst = node) AS i, (SELECT count(*) FROM edges WHERE src = node) AS o FROM n)
  SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) FILTER (WHERE i = 0) AS zero_in,
  count(*) FILTER (WHERE o = 0) AS zero_out, count(*) FILTER (WHERE i > 0 AND o > 0) AS nonzero_in_out FROM s""", "G-07")
def _(t):
    return graph.graph_summary(edges(t))


@query("threshold_network", f"SELECT least(a, b) AS src, greatest(a, b) AS dst, max(rho) AS weight FROM ({RANKED}" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS rho FROM k" for a in "FOP" for b in "FOP" if a != b)
    + ") WHERE round(rho, 2) >= -0.3 GROUP BY 1, 2", "G-08")
def _(t):
    wide = reshape.to_wide(status_weeks(t), "week_start", "series", list("FOP"), "n").dropna()
    return graph.threshold_network(stats.corr_matrix(wide, list("FOP"), "spearman"), -0.3)


@query("graph_view", f"WITH {EDGES} SELECT 'multi' AS view, src, dst FROM edges UNION ALL "
       "SELECT * FROM (SELECT DISTINCT 'simple', least(src, dst), greatest(src, dst) FROM edges)", "G-09")
def _(t):
    e = edges(t)
    simple = graph.graph_view(e, directed=False, multi=False)
    return graph.graph_view(e).select(F.lit("multi").alias("view"), "src", "dst").unionByName(
        simple.select(F.lit("simple").alias("view"), "src", "dst"))


@query("encoded_edges", f"""WITH {EDGES}, l AS (SELECT src AS x FROM edges UNION SELECT dst FROM edges), c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS id FROM l)
  SELECT a.id AS "FromNodeId", b.id AS "ToNodeId" FROM edges JOIN c a ON a.x = src JOIN c b ON b.x = dst""", "R-04 IO-07")
def _(t):
    from panelweave.session import scratch_path
    from panelweave.sources import writers
    coded = reshape.encode_labels(edges(t), ["src", "dst"])
    path = writers.export_delimited(coded, scratch_path(t.spark, "edges"), ["src_enc", "dst_enc"], sep="\t", header=False)
    return t.spark.read.schema("FromNodeId bigint, ToNodeId bigint").option("sep", "\t").csv(path)
