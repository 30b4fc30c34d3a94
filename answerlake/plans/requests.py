"""A whole request batch: check, route, answer, and the tables after it."""

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.functions.ranking import Gate
from answerlake.functions.text import with_role
from answerlake.functions.vectors import l2_normalize
from answerlake.operators import maintain as M
from answerlake.operators.shaping import blacklist_filter, read_by_verb, route_requests, validate_requests
from answerlake.plans.cache_lookup import cache_lookup
from answerlake.runtime import broadcast_if_small, cut_lineage
from answerlake.sources.requests import explode_chat_info


@dataclass(frozen=True)
class Outcome:
    """Responses of a batch, its log rows, the tables after it, and the wall
    times (seconds) of its embedding and search steps.

    ``changes`` are the same changes of the entry table as small frames (hits, removes,
    inserts) for ``EntryTable.apply``, which writes no entry that they leave alone.
    ``query_log`` is the stored log after the batch, if one was given: without the rows of
    truncated tenants, with the rows of the batch."""

    responses: DataFrame
    log: DataFrame
    entries: DataFrame
    collections: DataFrame
    times: dict
    changes: dict
    query_log: DataFrame = None


def op_times(spark, times: dict, at: Column) -> DataFrame:
    """The wall times of a batch as rows (ts, op, seconds), one per step."""
    rows = spark.createDataFrame([(op, float(s)) for op, s in times.items()],
                                 "op string, seconds double")
    return rows.select(at.alias("ts"), "op", "seconds")


RESPONSE = ["request_id", "error_code", "error_desc", "cache_hit", "hit_id", "rank", "hit_query",
            "answer", "status"]


def plain(rows: DataFrame, code: Column, desc: Column, status: Column) -> DataFrame:
    """Responses without a lookup."""
    return rows.select(
        "request_id", code.cast("int").alias("error_code"), desc.alias("error_desc"),
        F.lit(False).alias("cache_hit"), F.lit(None).cast("string").alias("hit_id"),
        F.lit(None).cast("double").alias("rank"), F.lit("").alias("hit_query"),
        F.lit("").alias("answer"), status.alias("status"))


def delete_entries(entries: DataFrame, removes: DataFrame) -> DataFrame:
    """Soft-delete listed ids inside their tenant and drop truncated tenants."""
    listed = removes.where("remove_type = 'delete_by_id'").select(
        "model", F.explode("id_list").alias("id")).distinct()
    truncated = removes.where("remove_type = 'truncate_by_model'").select("model").distinct()
    kept = entries.join(broadcast_if_small(truncated), "model", "left_anti")
    marked = broadcast_if_small(listed).withColumn("_marked", F.lit(True))
    return (kept.join(marked, ["model", "id"], "left")
            .withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_marked", F.lit(False)))
            .select(*entries.columns))


def log_rows_of(answered: DataFrame, texts: DataFrame, rejected: DataFrame, given: DataFrame, at: Column,
                times: dict) -> DataFrame:
    """Log rows of a batch: its queries, and requests of unknown verbs."""
    logged = (answered.join(texts, "request_id")
              .unionByName(rejected.where(F.col("error_code") == S.BAD_TYPE).join(
                  given.select("request_id", "model"), "request_id").withColumn("query", F.lit(""))))
    return logged.select("request_id", at.alias("ts"), "error_code", "error_desc", "cache_hit",
                         "model", "query", "hit_query", "answer",
                         # every request of a batch waits for the whole batch
                         F.when(F.col("error_code") == S.BAD_TYPE, 0.0)
                         .otherwise(round(sum(times.values()), 2)).alias("delta_time"))


def without_truncated(query_log: DataFrame, removes: DataFrame, log: DataFrame) -> DataFrame:
    """The stored log without the tenants that the batch truncates, with the rows of the batch."""
    if query_log is None:
        return None
    gone = cut_lineage(removes.where("remove_type = 'truncate_by_model'").select("model").distinct(), "truncated")
    return (query_log.join(broadcast_if_small(gone), "model", "left_anti").select(*query_log.columns)
            .unionByName(log, allowMissingColumns=True))


def handle_requests(requests: DataFrame, entries: DataFrame, collections: DataFrame,
                    embed: Callable, dim: int, gate: Gate = Gate(),
                    key: Callable = with_role, normalize: bool = True, at: Column = None,
                    query_log: DataFrame = None, **search) -> Outcome:
    """Run parsed requests (see ``parse_requests``) against the tables.

    ``key(query)`` shapes the cache key and ``embed(rows)`` adds ``embedding``
    from the column ``key``; vectors of requests and entries are made unit length
    (a zero vector is a miss, or is not inserted). Queries and removals see the tables as they were
    before the batch; inserts come last. Unknown collections of inserts are
    registered. Every row is a request of its own and gets one response, whether or not
    its ``request_id`` is null or repeated; queries without a vector are misses, and
    inserts report pairs that were not kept.
    """
    at = M.now() if at is None else at
    # rows are told apart by a number of the written batch; request ids are only data
    checked = read_by_verb(blacklist_filter(validate_requests(requests)),
                           {"query": "query", "chat_info": "insert", "id_list": "remove"})
    checked = cut_lineage(checked.withColumnRenamed("request_id", "_given_id")
                          .withColumn("request_id", F.expr("uuid()")), "requests")
    given = checked.select("request_id", "_given_id")
    routed = route_requests(checked.drop("_given_id"))

    def named(rows):
        return (rows.join(given, "request_id").drop("request_id")
                .withColumnRenamed("_given_id", "request_id").select(*rows.columns))


    keyed = routed["query"].withColumn("key", F.when(F.size("query") > 0, key(F.col("query"))))
    no_key = keyed.where(F.col("key").isNull())
    asked = keyed.where(F.col("key").isNotNull()).select("request_id", "model", "key")
    asked = asked.join(embed(asked).select("request_id", "embedding"), "request_id", "left")
    if normalize:
        asked = asked.withColumn("embedding", l2_normalize(F.col("embedding")))
    start = time.perf_counter()
    asked = cut_lineage(asked, "queries")
    embedded = time.perf_counter()
    found = cut_lineage(cache_lookup(asked, entries, gate, **search), "responses")
    times = {"embedding": embedded - start, "search": time.perf_counter() - embedded}
    answered = found.withColumn("status", F.lit(""))

    pairs = explode_chat_info(routed["insert"].select("request_id", "model", "chat_info"))
    rows = embed(pairs.select("request_id", "model", F.when(F.size("chat_query") > 0, key(F.col("chat_query")))
                              .alias("key"), "answer").where("key is not null and answer is not null"))
    rows = cut_lineage(rows.withColumnRenamed("key", "question"), "inserts")
    usable = l2_normalize(F.col("embedding")) if normalize else F.col("embedding")
    kept = rows.where(usable.isNotNull()).groupBy("request_id").agg(F.count(F.lit(1)).alias("_kept"))
    asked_for = F.greatest(F.size("chat_info"), F.lit(0))
    lost = asked_for - F.coalesce("_kept", F.lit(0))
    inserted = plain(
        routed["insert"].join(kept, "request_id", "left"),
        F.when(asked_for == 0, S.INSERT_FAILED).when(lost > 0, S.INSERT_REJECTED).otherwise(S.OK),
        F.when(asked_for == 0, "no chat_info").when(lost > 0, F.concat(
            lost.cast("string"), F.lit(" of "), asked_for.cast("string"), F.lit(" pairs not inserted"))).otherwise(""),
        F.when((asked_for == 0) | (lost > 0), "exception").otherwise("success"))

    status = M.remove_status(routed["remove"], entries).withColumn("error_desc", F.lit(""))
    removed = plain(status, F.col("error_code"), F.col("error_desc"), F.col("status"))

    wanted = routed["register"].select("request_id", "model", F.lit(None).cast("string").alias("mm_type"))
    result, known = M.register_collections(
        wanted.unionByName(routed["insert"].select(
            "request_id", "model", F.lit(None).cast("string").alias("mm_type"))), collections, dim,
        gate.metric)
    registered = wanted.join(result.select("model", "error_code", "response"), "model")
    registered = plain(registered, F.col("error_code"), F.lit(""), F.col("response"))

    rejected = plain(routed["rejected"], F.col("error_code"), F.col("error_desc"), F.lit(""))
    failed = plain(no_key, F.lit(S.QUERY_FAILED), F.lit("no query"), F.lit(""))
    responses = answered.select(*RESPONSE)
    for part in (failed, inserted, removed, registered, rejected):
        responses = responses.unionByName(part)

    texts = routed["query"].select("request_id", "model", F.to_json("query").alias("query"))
    log = log_rows_of(answered.select(*RESPONSE).unionByName(failed), texts, rejected, routed["rejected"], at, times)
    inserts = rows.drop("request_id")
    after = delete_entries(M.apply_hit_counts(entries, found, at), routed["remove"])
    after = M.insert_entries(after, inserts, normalize=normalize, at=at)
    return Outcome(named(responses), named(log), after.select(*entries.columns), known, times,
                   {"hits": found, "removes": routed["remove"], "inserts": inserts},
                   without_truncated(query_log, routed["remove"], log))
