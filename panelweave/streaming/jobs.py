"""Incremental ingest, weekly aggregates and scoring.

Sources are folders of files; time columns without a zone are cast, since
watermarks need zoned timestamps. Sinks write through ``foreachBatch`` and are
safe to replay: a batch writes its own folder, and a replay rewrites it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.models import score_batches


def read_stream(spark: SparkSession, folder, schema, ts, pattern="*.parquet", files_per_trigger=None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def deduped(stream, ts, key, delay="7 days") -> DataFrame:
    """First row of each id within the watermark delay."""
    keys = [key] if isinstance(key, str) else list(key)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def weekly_totals(stream, ts, entity, aggs, label="same_week", delay="14 days") -> DataFrame:
    """Tumbling seven-day windows per entity.

    ``same_week`` windows start on Monday and carry that date; ``trailing``
    windows run Tuesday to Monday and carry the closing Monday. The epoch is a
    Thursday, hence the start offsets.
    """
    offset = {"same_week": "4 days", "trailing": "5 days"}[label]
    grouped = stream.withWatermark(ts, delay).groupBy(
        F.window(ts, "7 days", "7 days", offset).alias("_w"), F.col(entity)).agg(*aggs)
    day = F.to_date("_w.start")
    week = day if label == "same_week" else F.date_add(day, 6)
    return grouped.withColumn("week_start", week).drop("_w")


def split_late(stream, ts, out, late, checkpoint, delay_days=14):
    """Write rows on time to ``out`` and late rows to ``late``.

    A row is late if it is older than the largest time of earlier batches by
    more than the delay: what a watermark of that delay may drop without a
    trace. Each batch stores the largest time so far (one row), so a batch reads
    one earlier mark and a replayed batch sees the same limit.
    """
    def write(df, batch):
        spark, marks = df.sparkSession, f"{out}-marks"
        top = spark.read.parquet(_batch_folder(marks, batch - 1)).first()[0] if batch > 0 else None
        top = F.lit(top).cast("timestamp")
        old = F.coalesce(F.col(ts) < top - F.expr(f"INTERVAL {delay_days} DAYS"), F.lit(False))
        df.where(~old).write.mode("overwrite").parquet(_batch_folder(out, batch))
        df.where(old).write.mode("overwrite").parquet(_batch_folder(late, batch))
        df.agg(F.greatest(F.max(ts), top).alias("top")).write.mode("overwrite").parquet(_batch_folder(marks, batch))
    return (stream.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _batch_folder(out, batch):
    return f"{out}/batch={batch}"


def append_to(stream, out, checkpoint):
    """Append rows; each batch owns one folder."""
    def write(df, batch):
        df.write.mode("overwrite").parquet(_batch_folder(out, batch))
    return (stream.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def upsert_to(stream, out, checkpoint):
    """Write changed groups; the newest batch of a group holds its value."""
    def write(df, batch):
        df.write.mode("overwrite").parquet(_batch_folder(out, batch))
    return (stream.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_latest(spark, out, keys) -> DataFrame:
    """Current value of every group written by ``upsert_to``."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
            .select(*keys, "_r.*"))


def read_appended(spark, out) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


# The state of long-lived streams lies in RocksDB: on the executors' disks, with
# bounded memory, and by its changes in the stream's checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def start_on_disk(spark, start):
    """Call ``start`` with the session's state store set to ``STATE``; a stream
    keeps the settings it was started with, and the session gets its own back."""
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        return start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def score_pending(stream, out, checkpoint, model_fn, schema, key):
    """Score rows that no earlier batch has scored, then append the scores.

    The stream checkpoint replaces resume files. The ids scored so far are keyed
    state of the stream, dealt by id over the state partitions and kept in
    RocksDB, so a batch looks up its own ids, reads no earlier output, and needs
    no more memory however many ids there are; a replayed batch gets the same
    rows again and rewrites its folder.
    """
    def write(df, batch):
        score_batches(df, model_fn, schema).write.mode("overwrite").parquet(_batch_folder(out, batch))

    writer = (stream.dropDuplicates([key]).writeStream.foreachBatch(write).outputMode("append")
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    return start_on_disk(stream.sparkSession, writer.start)
