"""Graph measures as joins on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.arrays import adjacent_pairs, append
from panelweave.operators.joins import hot_keys, salted_join
from panelweave.operators.windows import shift_in_group
from panelweave.session import settle


def cooccurrence_edges(df, tags, category) -> DataFrame:
    """Neighbouring tags of a row, with the row's category appended last, so
    that only the last tag links to it."""
    rows = df.select(append(tags, category).alias("_tags"))
    return adjacent_pairs(rows, "_tags", "src", "dst")


def transition_edges(df, entity, time, state) -> DataFrame:
    """Previous state to current state, one row per observed step."""
    steps = shift_in_group(df, entity, time, state, "_old")
    return steps.select(F.col("_old").alias("src"), F.col(state).alias("dst"))


def weigh(edges, src="src", dst="dst") -> DataFrame:
    """Number of edges per (src, dst)."""
    return edges.groupBy(src, dst).agg(F.count(F.lit(1)).alias("weight"))


def transition_matrix(edges, states) -> DataFrame:
    """Edge counts for every pair of listed states, zero included."""
    spark = edges.sparkSession
    one = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("src"))
    # states x states rows, by definition of the result
    grid = one.crossJoin(F.broadcast(one.select(F.col("src").alias("dst"))))
    return grid.join(weigh(edges), ["src", "dst"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0)))


def graph_view(edges, directed=True, multi=True) -> DataFrame:
    """The edge list as a directed multigraph (as it is), a directed simple
    graph, or an undirected simple graph with src <= dst."""
    if not directed:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edges if multi else edges.distinct()


def symmetric(edges) -> DataFrame:
    """Both directions of every undirected edge, without loops or repeats."""
    simple = graph_view(edges, directed=False, multi=False).where("src <> dst")
    return simple.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbor")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbor")))).alias("_e")).select("_e.*")


def degrees(edges, mode="all") -> DataFrame:
    """Degree per node: ``in``, ``out`` or ``all`` (a loop counts twice)."""
    ends = {"in": ["dst"], "out": ["src"], "all": ["src", "dst"]}[mode]
    nodes = edges.select(F.explode(F.array(*ends)).alias("node"))
    return nodes.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges, mode="all") -> DataFrame:
    """Number of nodes per degree; nodes of degree 0 are included."""
    counted = degrees(edges, mode)
    if mode != "all":
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        counted = nodes.join(counted, "node", "left").withColumn(
            "degree", F.coalesce("degree", F.lit(0).cast("bigint")))
    return counted.groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def degree_centrality(edges) -> DataFrame:
    """Neighbours divided by the number of other nodes."""
    per_node = neighbors(edges)
    total = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(
        F.count(F.lit(1)).alias("_n"))
    return per_node.crossJoin(F.broadcast(total)).select(
        "node", F.try_divide(F.col("n_neighbors"), F.col("_n") - 1).alias("centrality"))


def neighbors(edges, nodes=None) -> DataFrame:
    """Number of distinct one-hop neighbours per node, loops left out."""
    counted = symmetric(edges).groupBy("node").agg(F.count(F.lit(1)).alias("n_neighbors"))
    return counted.where(F.col("node").isin(list(nodes))) if nodes is not None else counted


def label_activity(tagged, tags, labels) -> dict:
    """Rows that carry each label, counted from the tagged posts; a list that
    names a label twice counts once. One number per label reaches the driver."""
    row = tagged.agg(*[F.count_if(F.array_contains(tags, v)).alias(f"n{i}") for i, v in enumerate(labels)]).first()
    return dict(zip(labels, row))


def neighbor_overlap(edges, labels, activity=None, order=None) -> DataFrame:
    """Common neighbours of every ordered pair of listed label nodes.

    Only edges that touch a label are read; one pass sums a flag product per
    pair. ``activity`` (label -> rows, see ``label_activity``) adds the
    activity-scaled ratios.
    """
    labels = list(labels)
    near = symmetric(edges).where(F.col("node").isin(labels))
    flags = near.groupBy("neighbor").agg(*[
        F.max(F.when(F.col("node") == v, 1).otherwise(0)).alias(f"f{i}") for i, v in enumerate(labels)])
    ids = range(len(labels))
    sums = flags.agg(
        *[F.sum(f"f{i}").alias(f"n{i}") for i in ids],
        *[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"c{i}_{j}") for i in ids for j in ids if i != j])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cells = [F.struct(F.lit(labels[i]).alias("orig"), F.lit(labels[j]).alias("direc"),
                      zero(f"c{i}_{j}").alias("comm"), zero(f"n{i}").alias("n_nodes1"),
                      zero(f"n{j}").alias("n_nodes2")) for i in ids for j in ids if i != j]
    out = sums.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    out = out.withColumn("perc", F.try_divide("comm", "n_nodes1")).withColumn(
        "nover", F.try_divide(F.col("comm"), F.col("n_nodes1") + F.col("n_nodes2") - 2 - F.col("comm")))
    out = out.withColumn("perc2", F.col("perc") * F.try_divide("n_nodes1", "n_nodes2"))
    if activity:
        pick = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in activity.items() for x in kv]), F.col(c))
        out = out.withColumn("n_orig", pick("orig")).withColumn("n_direc", pick("direc"))
        out = out.withColumn("prov", F.try_divide("n_nodes1", "n_orig")).withColumn(
            "prov2", F.try_divide("n_nodes2", "n_direc"))
        out = out.withColumn("perc_act", F.try_divide("prov2", "prov"))
    if order:
        place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("direc"))
        out = out.withColumn("order", F.coalesce(place, F.lit(0.0)))
    return out


def triangles(edges, both=None) -> DataFrame:
    """Triangles through each node; ``both`` is the stored ``symmetric`` table.

    Edges point from the smaller to the larger degree, so a node has no more
    out-neighbours than the square root of twice the number of edges. Pairs of
    out-neighbours are formed inside a node's row, and those that are an edge
    themselves close a triangle; no list travels to another task. By that order
    there are at most m ** 1.5 such pairs for m edges.
    """
    both = settle(symmetric(edges)) if both is None else both
    degree = settle(both.groupBy("node").agg(F.count(F.lit(1)).alias("count")))
    pairs = both.where("node < neighbor")
    # a node's degree bounds its rows on either side, so one list of hot nodes serves both joins
    hot = hot_keys(degree, ["node"])
    ranked = salted_join(pairs, degree.toDF("node", "d1"), "node", hot=hot) if hot is not None else pairs.join(degree.toDF("node", "d1"), "node")
    side = degree.toDF("neighbor", "d2")
    ranked = (salted_join(ranked, side, "neighbor", hot=hot.withColumnRenamed("node", "neighbor")) if hot is not None
              else ranked.join(side, "neighbor"))
    forward = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("node") < F.col("neighbor")))
    arcs = ranked.select(
        F.when(forward, F.col("node")).otherwise(F.col("neighbor")).alias("u"),
        F.when(forward, F.col("neighbor")).otherwise(F.col("node")).alias("v"))
    lists = arcs.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("outs")).where(F.size("outs") > 1)
    first = lists.select("u", F.posexplode("outs").alias("i", "node"), "outs")
    wedges = first.select("u", "node", F.explode(F.slice("outs", F.col("i") + 2, F.size("outs"))).alias("neighbor"))
    closed = wedges.join(pairs, ["node", "neighbor"], "left_semi")
    return (closed.select(F.explode(F.array("u", "node", "neighbor")).alias("node"))
            .groupBy("node").agg(F.count(F.lit(1)).alias("n_triangles")))


def clustering_coefficient(edges) -> DataFrame:
    """Triangles through a node over its neighbour pairs; 0 below two
    neighbours."""
    # the simple edges are read several times
    both = settle(symmetric(edges))
    counted = both.groupBy("node").agg(F.count(F.lit(1)).alias("n_neighbors")).join(
        triangles(edges, both), "node", "left")
    d, t = F.col("n_neighbors"), F.coalesce(F.col("n_triangles"), F.lit(0).cast("bigint"))
    return counted.select("node", "n_neighbors", t.alias("n_triangles"), F.coalesce(
        F.try_divide(2.0 * t, (d * (d - 1)).cast("double")), F.lit(0.0)).alias("coefficient"))


def graph_summary(edges) -> DataFrame:
    """Nodes, edges and nodes without incoming or outgoing edges; one row."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("_e")).select("_e.*")
    per_node = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return per_node.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("o").alias("edges"),
        F.count_if(F.col("i") == 0).alias("zero_in"), F.count_if(F.col("o") == 0).alias("zero_out"),
        F.count_if((F.col("i") > 0) & (F.col("o") > 0)).alias("nonzero_in_out"))


def threshold_network(corr, threshold=0.49, a="a", b="b", rho="rho") -> DataFrame:
    """Undirected edges between different series whose rounded correlation
    reaches the threshold; (a, b) and (b, a) are one edge."""
    near = corr.where((F.round(rho, 2) >= threshold) & (F.col(a) != F.col(b)))
    return near.groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(
        F.max(rho).alias("weight"))
