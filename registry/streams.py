"""Streaming jobs, run until their input is used up."""

from pyspark.sql import functions as F

from answerlake.runtime import shared_dir
from answerlake.streaming import jobs as J
from registry import query
from registry import tables as t
from registry.evaluation import _lookup_sql
from registry.maintenance import FRESH, at, fresh_rows

_FILES = 4


def as_stream(df, name, per_batch=1, time=None):
    """Write a frame as several files and read them as a stream of batches.

    With ``time`` a file holds a span of that column and the spans are read in order, as a
    watermark drops rows that come much later than others.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if time is None:
        df.repartition(_FILES).write.parquet(path)
    else:
        low, high = df.agg(F.min(time), F.max(time)).first()
        cuts = [low + (high - low) * i / _FILES for i in range(1, _FILES)]
        for a, b in zip([None, *cuts], [*cuts, None]):
            span = df if a is None else df.where(F.col(time) >= F.lit(a).cast("timestamp_ntz"))
            span = span if b is None else span.where(F.col(time) < F.lit(b).cast("timestamp_ntz"))
            span.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _run(start, spark, name):
    """Run a job in new folders and wait for its end; gives the output folder."""
    path, checkpoint = shared_dir(spark, name), shared_dir(spark, name + "-checkpoint")
    q = start(path, checkpoint)
    q.awaitTermination()
    return path


@query("stream_lookup", _lookup_sql())
def stream_lookup(spark, sf):
    asked = as_stream(t.planted(spark, sf), "requests", per_batch=2)
    path = _run(lambda p, c: J.stream_lookup(asked, lambda: t.entries(spark, sf), p, c),
                spark, "responses")
    return spark.read.parquet(path).drop("batch").withColumn("rank", F.round("rank", 6))


@query("stream_insert", f"""WITH {FRESH} SELECT id, model, question, answer, {t.sql_digest()} FROM fresh""")
def stream_insert(spark, sf):
    rows = fresh_rows(spark, sf).select("model", "question", "answer", "embedding")
    twice = as_stream(rows.unionByName(rows), "chat", per_batch=2)
    path = _run(lambda p, c: J.stream_insert(twice, p, c, lambda batch: batch, at=at()), spark, "entries")
    return spark.read.parquet(path).select("id", "model", "question", "answer", *t.vector_digest())


@query("stream_log", f"""WITH {t.LOG} SELECT log_id, ts, error_code, cache_hit, model, query, answer, delta_time FROM query_log""")
def stream_log(spark, sf):
    log = t.query_log(spark, sf).drop("user_id")
    path = _run(lambda p, c: J.stream_log(as_stream(log, "log"), p, c), spark, "query-log")
    return spark.read.parquet(path).select(
        "log_id", "ts", "error_code", "cache_hit", "model", "query", "answer", "delta_time")


def _windows_sql(start, extra=""):
    return f"""WITH {t.LOG}, placed AS (SELECT *, {start} AS window_start FROM query_log{extra})
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, model, count(*) AS queries,
  count(*) FILTER (WHERE cache_hit) AS hits, round(avg(cache_hit::INTEGER), 6) AS hit_rate
FROM placed WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM query_log)
GROUP BY window_start, model"""


def _hit_rate(spark, sf, slide=None):
    log = as_stream(t.query_log(spark, sf), "log", time="ts")
    path = _run(lambda p, c: J.append_windows(J.hit_rate_windows(log, slide=slide), p, c),
                spark, "hit-rate")
    return spark.read.parquet(path).withColumn("hit_rate", F.round("hit_rate", 6))


@query("stream_hit_rate", _windows_sql("date_trunc('hour', ts)"))
def stream_hit_rate(spark, sf):
    return _hit_rate(spark, sf)


@query("stream_hit_rate_sliding", _windows_sql(
    "time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * s)", ", range(0, 4) r(s)"))
def stream_hit_rate_sliding(spark, sf):
    return _hit_rate(spark, sf, slide="15 minutes")


@query("stream_sessions", """WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS turns
FROM numbered GROUP BY user_id, session
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, sf):
    turns = as_stream(t.read(spark, sf, "events").select("user_id", "ts"), "turns", time="ts")
    path = _run(lambda p, c: J.append_windows(J.session_windows(turns), p, c), spark, "sessions")
    return spark.read.parquet(path)


@query("stream_hit_counts", f"""WITH {t.LOG} SELECT substr(answer, 2) AS id, count(*) AS hit_count
FROM query_log WHERE cache_hit GROUP BY ALL""")
def stream_hit_counts(spark, sf):
    hits = t.query_log(spark, sf).select("cache_hit", F.expr("substr(answer, 2)").alias("hit_id"))
    path = _run(lambda p, c: J.stream_hit_counts(as_stream(hits, "responses"), p, c), spark, "hit-counts")
    return J.current_hit_counts(spark, path)


@query("stream_dedup_requests", """SELECT event_id::VARCHAR AS request_id, ts, event_type AS type FROM events""")
def stream_dedup_requests(spark, sf):
    """Every request arrives twice."""
    e = t.read(spark, sf, "events").select(F.col("event_id").cast("string").alias("request_id"),
                                           "ts", F.col("event_type").alias("type"))
    twice = as_stream(e.unionByName(e), "requests", time="ts")
    path = _run(lambda p, c: J.stream_dedup_requests(twice, p, c), spark, "requests-once")
    return spark.read.parquet(path)
