"""Table writes, cached steps and delimited exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.spread import stable_hash

# Stamps keep their microseconds in text form.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a finished write."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def write_table(df: DataFrame, path, mode="errorifexists", by=None) -> str:
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*([by] if isinstance(by, str) else by))
    writer.parquet(path)
    return path


def write_sharded(df: DataFrame, path, n, key, shard="shard", mode="errorifexists") -> str:
    """Write ``n`` shards of about equal size, one folder per shard.

    The shard of a row comes from the hash of its key, so a rewrite gives the
    same shards, and no row count is needed first.
    """
    rows = df.withColumn(shard, F.pmod(stable_hash(key), F.lit(n)).cast("int"))
    rows.repartition(n, shard).write.mode(mode).partitionBy(shard).parquet(path)
    return path


def export_delimited(df: DataFrame, path, cols=None, rename=None, sep=",", header=True,
                     compression=None, mode="errorifexists") -> str:
    """Projected text export."""
    out = df.select(*cols) if cols else df
    out = out.withColumnsRenamed(rename) if rename else out
    writer = (out.write.mode(mode).option("header", header).option("sep", sep).option("escape", '"')
              .option("timestampFormat", STAMP + "XXX").option("timestampNTZFormat", STAMP))
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
    return path


def compute_or_load(spark: SparkSession, path, make) -> DataFrame:
    """Read the finished table at ``path``; compute and store it if absent. An
    unfinished earlier write is replaced."""
    if not path_exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model, path) -> str:
    model.write().overwrite().save(path)
    return path


def fit_or_load(spark: SparkSession, path, kind, fit):
    """Load a stored model, or fit and store it. ``kind`` is the model class."""
    marker = f"{path.rstrip('/')}/metadata"
    if path_exists(spark, marker):
        return kind.load(path)
    model = fit()
    save_model(model, path)
    return model
