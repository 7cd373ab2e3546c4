"""Sources and sinks: each query writes a given table through a sink and reads
it back through a source."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import query
from catalog.inputs import KINDS, PANEL, TOKENS, panel, r
from panelweave.session import scratch_path
from panelweave.sources import readers, writers

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
NATION = T.StructType([
    T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()),
    T.StructField("n_regionkey", T.IntegerType()),
])
EVENT_SQL = ("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, "
             f"{r('value')} AS value, props FROM events")


@query("read_posts_parquet", EVENT_SQL, "IO-01")
def _(t):
    return readers.read_posts(t.spark, t.path("events"), EVENTS, "parquet")


@query("read_posts_csv", EVENT_SQL, "IO-01")
def _(t):
    path = writers.export_delimited(t.events, scratch_path(t.spark, "posts-csv"))
    return readers.read_posts(t.spark, path, EVENTS, "csv")


@query("read_dim_csv", "SELECT CAST(n_nationkey AS BIGINT) n_nationkey, n_name, "
       "CAST(n_regionkey AS BIGINT) n_regionkey FROM nation", "IO-02")
def _(t):
    path = writers.export_delimited(t.nation, scratch_path(t.spark, "nation"))
    return readers.read_dim_csv(t.spark, path, NATION)


@query("read_csv_dir", "SELECT o_orderkey, o_custkey, o_orderstatus, "
       f"{r('o_totalprice')} AS o_totalprice FROM orders", "IO-03")
def _(t):
    path = scratch_path(t.spark, "orders-dir")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    t.orders.select(*cols).repartition(4).write.option("header", True).csv(path)
    schema = T.StructType([f for f in t.orders.schema if f.name in cols])
    return readers.read_csv_dir(t.spark, path, schema)


SHARD = "('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT % 10"


@query("read_shards", f"SELECT {SHARD} AS shard, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids "
       "FROM events GROUP BY 1", "IO-04 IO-06")
def _(t):
    path = writers.write_sharded(t.events, scratch_path(t.spark, "shards"), 10, "event_id")
    rows = readers.read_shards(t.spark, path, t.events.schema)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("missing_shards", f"SELECT i AS shard FROM range(10) g(i) WHERE i NOT IN "
       f"(SELECT {SHARD} FROM events WHERE {SHARD} NOT IN (3, 7))", "IO-04")
def _(t):
    path = writers.write_sharded(t.events, scratch_path(t.spark, "some-shards"), 10, "event_id")
    seen = readers.read_shards(t.spark, path, t.events.schema)
    return readers.missing_shards(seen.where("shard not in (3, 7)"), 10)


PANEL_OUT = f"""WITH {PANEL} SELECT entity, CAST(week_start AS VARCHAR) AS week_start,
  {r('prediction')} AS prediction, n_posts, {', '.join(KINDS)} FROM panel"""


@query("write_table", PANEL_OUT, "IO-05")
def _(t):
    path = writers.write_table(panel(t), scratch_path(t.spark, "panel"))
    return t.spark.read.parquet(path)


@query("export_delimited", f"WITH {PANEL} SELECT entity AS user_id, CAST(week_start AS VARCHAR) AS week_start, "
       f"{r('prediction')} AS score FROM panel", "IO-07")
def _(t):
    path = writers.export_delimited(
        panel(t), scratch_path(t.spark, "export"), ["entity", "week_start", "prediction"],
        {"entity": "user_id", "prediction": "score"}, sep="\t", compression="gzip")
    schema = T.StructType([
        T.StructField("user_id", T.LongType()), T.StructField("week_start", T.DateType()),
        T.StructField("score", T.DoubleType())])
    return t.spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


@query("compute_or_load", PANEL_OUT, "IO-08")
def _(t):
    path = scratch_path(t.spark, "step")
    writers.compute_or_load(t.spark, path, lambda: panel(t))

    def again():
        raise AssertionError("the stored table was not used")
    return writers.compute_or_load(t.spark, path, again)


@query("fit_or_load", f"WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS DOUBLE) AS n_tokens FROM tok", "IO-09")
def _(t):
    from pyspark.ml import Pipeline, PipelineModel

    from catalog.inputs import tokens
    path = scratch_path(t.spark, "model")
    docs = tokens(t)
    fit = lambda: Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="f", numFeatures=1024)]).fit(docs)
    writers.fit_or_load(t.spark, path, PipelineModel, fit)
    loaded = writers.fit_or_load(t.spark, path, PipelineModel, lambda: None)
    from pyspark.ml.functions import vector_to_array
    return loaded.transform(docs).select(
        "doc_id", F.aggregate(vector_to_array("f"), F.lit(0.0), lambda a, x: a + x).alias("n_tokens"))


@query("read_results", PANEL_OUT, "IO-10")
def _(t):
    rows = panel(t)
    path = writers.write_table(rows, scratch_path(t.spark, "results"))
    return readers.read_results(t.spark, path, rows.schema)
