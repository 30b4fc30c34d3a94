"""Streaming forms of the lookups, inserts, logs and reports.

Every job takes a streaming frame and returns the started query. Batches are
written to a folder per batch id in overwrite mode, so a batch that runs again
after a failure replaces its own output.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from answerlake.operators.maintain import assign_ids, fresh_entries, new_entries
from answerlake.plans.cache_lookup import cache_lookup
from answerlake.runtime import cut_lineage, remove_folder, scratch
from answerlake.sources.entry_table import folder_names

RUNS = 8


def _start(writer, checkpoint: str, trigger: dict = None) -> StreamingQuery:
    """Use up the input and stop, or run under the given trigger."""
    trigger = trigger or {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _each_batch(stream: DataFrame, run, path: str, checkpoint: str, trigger: dict = None,
                folders: list = ()):
    def write(batch: DataFrame, batch_id: int):
        with scratch(batch.sparkSession):  # a batch leaves only its output
            (run(batch, batch_id).write.mode("overwrite").partitionBy(*folders)
             .parquet(f"{path}/batch={batch_id}"))
    return _start(stream.writeStream.outputMode("append").foreachBatch(write), checkpoint, trigger)


def stream_lookup(requests: DataFrame, entries, path: str, checkpoint: str,
                  trigger: dict = None, **options) -> StreamingQuery:
    """Answer a stream of (request_id, model, key, embedding).

    ``entries()`` gives the entry table; it is called for every batch, so a
    batch reads the newest snapshot. The nearest entries of a request are a
    top-k, which streams only offer inside a batch.
    """
    return _each_batch(requests, lambda batch, _: cache_lookup(batch, entries(), **options),
                       path, checkpoint, trigger)


def stream_insert(rows: DataFrame, path: str, checkpoint: str, embed, at=None,
                  trigger: dict = None, entries=None, within: str = None) -> StreamingQuery:
    """Append the entries of a (model, question, answer) stream, a folder for each tenant.

    Ids are content hashes, and the state store of the query remembers those it has seen, so
    rows seen before, in this or an earlier batch, add nothing, and no batch reads what
    earlier ones wrote. ``embed(batch)`` adds the vectors and is called with new rows only.
    ``within`` forgets an id that long (event time ``ts``) after it came; a job that forgets
    should give ``entries()``, the entry table: rows that it holds live add nothing either.
    Large states want the RocksDB state store.
    """
    ided = assign_ids(rows)
    if within:
        once = _timed(ided, within).dropDuplicatesWithinWatermark(["id"]) if rows.isStreaming else ided
    else:
        once = ided.dropDuplicates(["id"])

    def insert(batch, _):
        batch = cut_lineage(batch, "batch")  # the state is advanced once
        new = embed(batch)
        if entries is None:
            return new_entries(new, at=at)
        return fresh_entries(entries().select("id", "is_deleted"), new, at=at)
    return _each_batch(once, insert, path, checkpoint, trigger, ["model"])


def stream_log(responses: DataFrame, path: str, checkpoint: str,
               trigger: dict = None) -> StreamingQuery:
    """Append responses to the query log under daily folders."""
    rows = responses.withColumn("day", F.to_date("ts"))
    return _start(rows.writeStream.format("parquet").outputMode("append")
                  .partitionBy("day").option("path", path), checkpoint, trigger)


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """Event time with a watermark on streams. Watermarks need a timestamp with
    time zone, so log times are read in the session's zone and given back
    without one by the callers."""
    return (rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
            if rows.isStreaming else rows)


def _local(column):
    return F.col(column).cast("timestamp_ntz")


def hit_rate_windows(log: DataFrame, window: str = "1 hour", slide: str = None,
                     delay: str = "10 minutes") -> DataFrame:
    """Hit rate per tenant and time window; ``slide`` makes the windows overlap.
    On a stream, rows later than ``delay`` are dropped and a window is emitted
    once the watermark has passed it."""
    rows = _timed(log, delay)
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (rows.groupBy(at.alias("w"), "model")
            .agg(F.count(F.lit(1)).alias("queries"), F.count_if("cache_hit").alias("hits"))
            .select(_local("w.start").alias("window_start"), _local("w.end").alias("window_end"),
                    "model", "queries", "hits", (F.col("hits") / F.col("queries")).alias("hit_rate")))


def session_windows(turns: DataFrame, user: str = "user_id", gap: str = "30 minutes",
                    delay: str = "10 minutes") -> DataFrame:
    """Dialogue sessions: one user's turns until a pause of ``gap``. For streams with hot
    users, set spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition, which
    merges rows to sessions before the shuffle."""
    rows = _timed(turns, delay)
    return (rows.groupBy(F.session_window("ts", gap).alias("w"), user)
            .agg(F.count(F.lit(1)).alias("turns"))
            .select(user, _local("w.start").alias("session_start"),
                    _local("w.end").alias("session_end"), "turns"))


def append_windows(windows: DataFrame, path: str, checkpoint: str,
                   trigger: dict = None) -> StreamingQuery:
    """Write closed windows or sessions to a folder."""
    return _start(windows.writeStream.format("parquet").outputMode("append")
                  .option("path", path), checkpoint, trigger)


def _runs(spark: SparkSession, path: str) -> list:
    """Complete runs (first batch, last batch) of counters."""
    found = [n for n in folder_names(spark, path) if n.startswith("run=")]
    return [tuple(int(x) for x in n.removeprefix("run=").split("-")) for n in found
            if "_SUCCESS" in folder_names(spark, f"{path}/{n}")]


def _run_path(path: str, run: tuple) -> str:
    return f"{path}/run={run[0]:012d}-{run[1]:012d}"


def _covered(run: tuple, runs: list) -> bool:
    return any(other != run and other[0] <= run[0] and run[1] <= other[1] for other in runs)


def _counters(spark: SparkSession, path: str, runs: list) -> DataFrame:
    """Counters only grow, so the newest of an entry is its largest."""
    schema = "id string, hit_count long"
    rows = spark.read.schema(schema).parquet(*[_run_path(path, r) for r in runs]) if runs else \
        spark.createDataFrame([], schema)
    return rows.groupBy("id").agg(F.max("hit_count").alias("hit_count"))


def stream_hit_counts(responses: DataFrame, path: str, checkpoint: str,
                      trigger: dict = None) -> StreamingQuery:
    """Running hits per entry: each batch writes a run of the counters it changed.

    Every ``RUNS`` batches their runs are merged to one, every ``RUNS * RUNS`` batches those,
    and so on, so the live runs are fewer than ``RUNS`` a level. A run counts from the moment it
    is complete; runs that it covers are deleted at the next merge, so a reader that has
    listed them has ``RUNS`` batches to read them. A batch that runs again writes the same.
    """
    session = responses.sparkSession
    counts = (responses.where("cache_hit").groupBy(F.col("hit_id").alias("id"))
              .agg(F.count(F.lit(1)).alias("hit_count")))

    def write(batch: DataFrame, batch_id: int):
        before = _runs(session, path)
        batch.write.mode("overwrite").parquet(_run_path(path, (batch_id, batch_id)))
        width = RUNS
        while (batch_id + 1) % width == 0:
            whole = (batch_id + 1 - width, batch_id)
            runs = [r for r in _runs(session, path) if r != whole and whole[0] <= r[0] and r[1] <= whole[1]]
            live = [r for r in runs if not _covered(r, runs)]
            _counters(session, path, live).write.mode("overwrite").parquet(_run_path(path, whole))
            width *= RUNS
        if width > RUNS:
            for run in before:
                if run[1] != batch_id and _covered(run, before):
                    remove_folder(session, _run_path(path, run))

    return _start(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger)


def current_hit_counts(spark: SparkSession, path: str) -> DataFrame:
    """Newest counter of each entry from the folder of ``stream_hit_counts``, also while it runs."""
    runs = _runs(spark, path)
    return _counters(spark, path, [r for r in runs if not _covered(r, runs)])


def dedup_requests(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each request id once, for repeats arriving within ``delay``."""
    once = _timed(requests, delay).dropDuplicatesWithinWatermark(["request_id"])
    return once.withColumn("ts", _local("ts"))


def stream_dedup_requests(requests: DataFrame, path: str, checkpoint: str,
                          delay: str = "1 hour", trigger: dict = None) -> StreamingQuery:
    return _start(dedup_requests(requests, delay).writeStream.format("parquet")
                  .outputMode("append").option("path", path), checkpoint, trigger)
