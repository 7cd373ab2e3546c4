"""Structured Streaming jobs, run to the end of the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import POSTS, r, score_of
from panelweave.operators.models import linear_scorer
from panelweave.session import scratch_path, settle
from panelweave.streaming import jobs


FILES = 4


# Files that make up a quarter, written and read by as many tasks.
SPLIT = 2


def _files(t, table, order, extra=None):
    """A table as FILES quarters in ascending ``order``, each of SPLIT files,
    written one after another, so that a stream that takes SPLIT files at a time
    sees FILES batches. ``extra`` adds rows to a quarter, given its number and
    all of its rows. The table is stored by quarter first and read by quarter."""
    folder = scratch_path(t.spark, "files")
    low, high = table.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((order - low) / ((high - low) / FILES + 1e-9)), F.lit(FILES - 1))
    rows = settle(table.withColumn("_part", part.cast("bigint")))
    for i in range(FILES):
        file = rows.where(F.col("_part") == i)
        if extra:
            file = file.unionByName(extra(i, rows))
        file.drop("_part").repartition(SPLIT).write.parquet(f"{folder}/{i}")
    return f"{folder}/*"


def _stream(t, path, schema):
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", SPLIT).parquet(path)


def _events(t, extra=None):
    path = _files(t, t.events, F.unix_micros(F.col("ts").cast("timestamp")).cast("double"), extra)
    return jobs.read_stream(t.spark, path, t.events.schema, "ts", files_per_trigger=SPLIT)


def _run(t, start, stream):
    out, mark = scratch_path(t.spark, "stream"), scratch_path(t.spark, "mark")
    start(stream, out, mark).awaitTermination()
    return out


@query("stream_dedupe", f"SELECT event_id, user_id, event_type, {r('value')} AS value FROM events", "SS-01")
def _(t):
    # every event arrives again, half with its own file and half with the next one
    def again(i, rows):
        now, before = F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1
        return rows.where(((F.col("_part") == i) & now) | ((F.col("_part") == i - 1) & before))

    out = _run(t, jobs.append_to, jobs.deduped(_events(t, again), "ts", "event_id", "30 days"))
    return jobs.read_appended(t.spark, out).select("event_id", "user_id", "event_type", "value")


FIRST_DAY = "CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)"


@query("stream_late_rows", f"SELECT event_id, user_id, 'on time' AS kind FROM events UNION ALL "
       f"SELECT event_id + 1000000000, user_id, 'late' FROM events WHERE {FIRST_DAY}", "SS-01 SS-02")
def _(t):
    # the events of the first day come once more, under other ids, with the last file
    first = t.events.agg(F.min("ts").cast("date")).first()[0]

    def late(i, rows):
        old = rows.where((F.col("ts").cast("date") == F.lit(first)) & F.lit(i == FILES - 1))
        return old.withColumn("event_id", F.col("event_id") + 1_000_000_000)

    out, side, mark = scratch_path(t.spark, "on-time"), scratch_path(t.spark, "late"), scratch_path(t.spark, "mark")
    jobs.split_late(_events(t, late), "ts", out, side, mark, delay_days=10).awaitTermination()
    kinds = [jobs.read_appended(t.spark, p).select("event_id", "user_id", F.lit(k).alias("kind")) for p, k in ((out, "on time"), (side, "late"))]
    return kinds[0].unionByName(kinds[1])


def _weekly(t, label):
    rows = _events(t).withColumn("score", score_of("event_type"))
    stream = jobs.weekly_totals(rows, "ts", "user_id", [
        F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("score_count")], label)
    out = _run(t, jobs.upsert_to, stream)
    return jobs.read_latest(t.spark, out, ["user_id", "week_start"])


@query("stream_weekly", f"WITH {POSTS} SELECT entity AS user_id, CAST(week_start AS VARCHAR) AS week_start, {r('sum(score)')} AS score_sum, "
       "count(*) AS score_count FROM posts GROUP BY 1, 2", "SS-02")
def _(t):
    return _weekly(t, "same_week")


@query("stream_weekly_trailing", f"WITH {POSTS} SELECT entity AS user_id, CAST(CAST(date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS week_start, "
       f"{r('sum(score)')} AS score_sum, count(*) AS score_count FROM posts GROUP BY 1, 2", "SS-02")
def _(t):
    return _weekly(t, "trailing")


def weights(dim, k=3):
    return [[float((j * 7 + c * 3) % 5 - 2) for j in range(dim)] for c in range(k)], [0.0] * k


SCORE_SQL = "CAST(list_sum(list_transform(embedding, lambda x, j: CAST(x AS DOUBLE) * (((j - 1) * 7 + {c} * 3) % 5 - 2))) AS DOUBLE)"
SCORED_SQL = f"""WITH s AS (SELECT vec_id, {', '.join(SCORE_SQL.format(c=c) + f' AS topic_{c}' for c in range(3))} FROM embeddings)
  SELECT vec_id, {', '.join(r(f'topic_{c}') + f' AS topic_{c}' for c in range(3))}, CASE WHEN topic_0 >= topic_1 AND topic_0 >= topic_2 THEN 0
  WHEN topic_1 >= topic_2 THEN 1 ELSE 2 END AS final_pred FROM s"""
SCORED = "vec_id bigint, topic_0 double, topic_1 double, topic_2 double, final_pred bigint"


@query("stream_score_pending", SCORED_SQL, "SS-03")
def _(t):
    dim = t.embeddings.select(F.size("embedding")).first()[0]
    # a tenth of the vectors returns with each following file
    path = _files(t, t.embeddings, F.col("vec_id").cast("double"),
                  lambda i, rows: rows.where((F.col("_part") < i) & (F.col("vec_id") % 10 == 0)))
    stream = _stream(t, path, t.embeddings.schema)
    w, b = weights(dim)
    out, mark = scratch_path(t.spark, "scores"), scratch_path(t.spark, "mark")
    jobs.score_pending(stream, out, mark, linear_scorer(w, b, "embedding", "vec_id"), SCORED, "vec_id").awaitTermination()
    return jobs.read_appended(t.spark, out)
