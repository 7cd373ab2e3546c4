"""Table reads with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.schemas import check_schema


def read_posts(spark: SparkSession, path, schema: T.StructType, fmt="csv") -> DataFrame:
    """The post table: CSV with a header, or Parquet. The schema is declared,
    never inferred; a CSV header that does not match it fails."""
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
                .option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path))
    return check_schema(spark.read.parquet(path), schema).select(*[f.name for f in schema])


def widen(df: DataFrame, key=None) -> DataFrame:
    """Deal rows over all cores when a scan has fewer splits than cores, as
    with one small file of long texts. A scan with enough splits is left as
    it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, key) if key else df.repartition(n)


def read_dim_csv(spark, path, schema) -> DataFrame:
    """A small reference table; a byte-order mark at the start is skipped."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_csv_dir(spark, folder, schema, pattern="*.csv") -> DataFrame:
    """All CSV files of a folder in one scan. Columns are matched to the
    schema by the header, file by file."""
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("pathGlobFilter", pattern).csv(folder))


def read_shards(spark, folder, schema, shard="shard", pattern=r"shard[=_](\d+)", skip_missing=False) -> DataFrame:
    """All shards below a folder with the shard number taken from the path.

    A shard that vanishes during the read fails it; with ``skip_missing`` it is
    left out, and ``missing_shards`` names the shards without rows."""
    rows = (spark.read.schema(schema).option("ignoreMissingFiles", skip_missing)
            .option("recursiveFileLookup", True).parquet(folder))
    return rows.withColumn(shard, F.regexp_extract(F.input_file_name(), pattern, 1).cast("int"))


def missing_shards(seen: DataFrame, expected: int, shard="shard") -> DataFrame:
    """Expected shard numbers without any row."""
    wanted = seen.sparkSession.range(expected).select(F.col("id").cast("int").alias(shard))
    return wanted.join(seen.select(shard).distinct(), shard, "left_anti")


def read_results(spark, path, schema=None) -> DataFrame:
    """A result table written earlier."""
    df = spark.read.parquet(path)
    return check_schema(df, schema) if schema is not None else df
