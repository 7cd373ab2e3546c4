"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import scratch_path

# A word: a run of characters other than space and the five control characters
# from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds).cast("int")


# Bytes of texts that a Python task is handed at a time, whatever their lengths.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches by bytes, so that long texts do not add
    up in a task. A smaller limit set by the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now or "").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, so that later
    steps neither repeat the work nor depend on the executors that did it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, text, y) of the documents that have a 0/1 label and lie outside
    the held-out fold. Repeated label rows of an id count once, the largest."""
    y = (labels.where(F.col(label).isin(0, 1))
         .groupBy(F.col("doc_id")).agg(F.max(label).cast("int").alias("y")))
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    return rows.join(y, "doc_id")
