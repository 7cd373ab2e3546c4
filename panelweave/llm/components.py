"""Connected components of links between ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import stored
from panelweave.operators.joins import salted_join
from panelweave.operators.spread import fits


def _open(edges: DataFrame) -> bool:
    """Whether some id points to two others, or to one that points on."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    found = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return not found.where("out > 1 OR (out > 0 AND in > 0)").isEmpty()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable.

    Links point from larger to smaller ids. Large-star and small-star rounds
    alternate until every id points straight to its root. The number of rounds grows with the logarithm
    of the longest chain. Each round is written to the shared folder, so lineage
    stays short.
    """
    edges = stored(links.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    count = 0
    while _open(edges):
        # Large star: what points to an id points on to the smallest id that this points to.
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m"), f"{name}-least-{count}")
        # Very many may point to one id: its links are not gathered by a shuffle.
        met = edges.join(F.broadcast(least), "b", "left") if fits(least) else salted_join(edges, least, "b", "left")
        large = met.select("a", F.coalesce("m", "b").alias("b")).distinct()
        # Small star: what an id points to points to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        met = large.join(least, F.col("a") == F.col("u"))
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        count += 1
        edges = stored(small.where("a <> b").distinct(), f"{name}-{count}")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
