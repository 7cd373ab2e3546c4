"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import WORD

# Rows that share source and size are numbered in one task up to about this many.
GROUP_ROWS = 100_000
OUT = ("size", "source_size", "target", "copies")


def words(text="text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: source_size, target.

    Sources, in code point order with null last, weigh ``weights`` in turn and
    share the sum of all sizes. A target stops at ``cap`` times its source's
    size; what is left goes to the others by weight. With the sources in order
    of size per weight, those that stop come first, so one running sum finds
    them. The table has one row per source; only those rows meet in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = (per
           .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0)))
           .withColumn("open", F.sum("weight").over(after))
           .withColumn("full", F.col("most").cast("double") * F.col("open") <= F.col("left").cast("double") * F.col("weight")))
    rest = F.when(~F.col("full"), F.struct("open", "left"))
    per = per.withColumn("rest", F.max(rest).over(whole))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(
        F.col("rest.left").cast("double") * F.col("weight") / F.col("rest.open"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to documents that carry
    ``doc_id``, ``source`` and ``size``.

    Every document of a source is expected target / source_size times. Within a
    source, documents stand by size and then by the md5 of their id; the running
    sum of expected copies, moved by one random offset of the source, is cut at
    whole numbers, and a document is taken once per whole number it crosses.
    Standing by size keeps the taken words near the target. A document is taken
    at most ``cap`` times.

    The running sum is the count of rows before, times the rate. Counts of
    (source, size, first md5 digits) are summed first; rows are then numbered
    inside such a group only. The number of digits follows from the largest
    (source, size) count, so no hot source or size meets in one task.

    A null source is a source of its own, last in order. Null or empty texts
    have size 0 and are taken like others, adding no words. Rows with the same
    id are separate documents. A source without any word has target 0 and none
    of its rows is taken. An empty table gives an empty one. Other columns pass
    through; columns called like an output column are replaced.
    """
    docs = docs.drop("source_size", "target", "copies")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    largest = docs.groupBy("source", "size").count().agg(F.max("count")).first()[0] or 0
    digits = 0
    while largest > GROUP_ROWS * 16 ** digits:
        digits += 1
    rows = docs.withColumn("__key", key).withColumn("__part", F.substring("__key", 1, digits))

    targets = source_targets(docs.select("source", "size"), weights, cap).withColumnRenamed("source", "__source")
    before = Window.partitionBy("source").orderBy("size", "__part").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("source", "size", "__part").agg(F.count(F.lit(1)).alias("__n"))
    groups = groups.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    groups = groups.join(targets, F.col("source").eqNullSafe(F.col("__source"))).select(
        F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("__part").alias("__part_"),
        "__before", "source_size", "target")

    met = rows.join(groups, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))
                    & (F.col("__part") == F.col("__part_")))
    inside = Window.partitionBy("source", "size", "__part").orderBy("__key", "doc_id")
    at = (F.row_number().over(inside) + F.col("__before")).cast("double")
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("source"), F.lit("")), F.lit(seed)))
    offset = F.conv(F.substring(name, 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(F.col("__at") * rate + offset) - F.floor((F.col("__at") - 1) * rate + offset)
    return (met.withColumn("__at", at).withColumn("copies", crossed.cast("long"))
            .drop("__key", "__part", "__source", "__size", "__part_", "__before", "__at"))


def repeat_rows(mixed: DataFrame, columns) -> DataFrame:
    """One row per copy."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")
    return mixed.where("copies > 0").select(*columns, times).drop("__copy")
