"""Multimodal lookups and inserts from request parts, and whole request batches."""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.functions.ranking import Gate
from answerlake.functions.text import mm_type
from answerlake.functions.vectors import l2_normalize
from answerlake.operators.embed import mm_concat
from answerlake.operators import maintain as M
from answerlake.operators.maintain import new_entries
from answerlake.operators.shaping import blacklist_filter, mm_key, route_requests, validate_requests
from answerlake.plans.cache_lookup import cache_lookup_mm
from answerlake.plans.requests import RESPONSE, Outcome, delete_entries, log_rows_of, plain, without_truncated
from answerlake.runtime import cut_lineage


def _shaped(requests: DataFrame, insert: bool) -> DataFrame:
    """Requests (.., part) with key, image and ``error_desc``."""
    fields = requests.select("*", "part.text", "part.imageRaw", "part.imageUrl", "part.imageId",
                             "part.multiType").withColumn("text", F.coalesce("text", F.array()))
    return mm_key(fields, insert=insert)


def answer_mm(requests: DataFrame, entries: DataFrame, embed: Callable,
              gate: Gate = Gate(short_text=S.SHORT_MM_TEXT), **options) -> DataFrame:
    """Responses to multimodal queries (request_id, model, part).

    ``embed(rows)`` adds ``image_vec`` and ``text_vec`` from ``image`` and
    ``key``; vectors are made unit length. A query whose parts do not fit its
    kind, or that gets no vector, is error 201.
    """
    shaped = cut_lineage(_shaped(requests, insert=False)
                         .select("request_id", "model", "key", "image", "multiType", "error_desc"),
                         "mm-requests")
    tagged, without = mm_concat(embed(shaped.where("error_desc = ''")))
    asked = cut_lineage(tagged.select(
        "request_id", "model", "key", mm_type(F.col("multiType")).alias("mm_type"),
        l2_normalize(F.col("embedding")).alias("embedding")), "mm-queries")
    found = cache_lookup_mm(asked, entries, gate, **options)
    failed = (shaped.where("error_desc <> ''").select("request_id", "error_desc").unionByName(
        without.select("request_id", F.lit("no vector").alias("error_desc"))))
    typed = {f.name: f.dataType for f in found.schema}
    values = {"error_code": F.lit(S.QUERY_FAILED), "cache_hit": F.lit(False), "hit_id": F.lit(None),
              "rank": F.lit(None)}
    return found.unionByName(failed.select(*[
        F.col(c) if c in ("request_id", "error_desc")
        else values.get(c, F.lit("")).cast(typed[c]).alias(c) for c in found.columns]))


def mm_entries(requests: DataFrame, embed: Callable, at: Column = None) -> tuple:
    """(entries of multimodal inserts (request_id, model, part, answer), rejects
    with the reason). The kind of an entry is that of the vectors it got."""
    # written once: it is read for good rows and for rejects
    shaped = cut_lineage(_shaped(requests, insert=True).select(
        "request_id", "model", "key", "image", "answer", "imageUrl", "imageId", "error_desc"),
        "mm-inserts")
    tagged, without = mm_concat(embed(shaped.where("error_desc = ''")))
    raw = F.coalesce(F.length("imageUrl") > 0, F.lit(False))
    rows = tagged.select("model", F.col("key").alias("question"), "answer", "mm_type",
                         F.col("imageUrl").alias("image_url"), F.col("imageId").alias("image_id"),
                         # a raw image is told apart by its hash; its bytes are not kept
                         F.when(~raw & F.col("image").isNotNull(), F.sha2("image", 256)).alias("image_hash"),
                         "embedding")
    rejects = (shaped.where("error_desc <> ''").select("request_id", "error_desc").unionByName(
        without.select("request_id", F.lit("no vector").alias("error_desc"))))
    return new_entries(rows, at=at), rejects


def handle_mm_requests(requests: DataFrame, entries: DataFrame, collections: DataFrame, embed: Callable,
                       dim: int, gate: Gate = Gate(short_text=S.SHORT_MM_TEXT), at: Column = None,
                       query_log: DataFrame = None, blocked=(), **search) -> Outcome:
    """Run parsed multimodal requests (see ``parse_mm_requests``) against the tables.

    As ``handle_requests``, with these differences: an insert stores its last pair, a query
    or insert whose parts do not fit is 201 or 301, registration is by (tenant, kind) and a
    kind that is none is 502, responses carry the image of the entry. No tenant is
    blocked unless named in ``blocked``.
    """
    at = M.now() if at is None else at
    checked = cut_lineage(blacklist_filter(validate_requests(requests), list(blocked))
                          .withColumnRenamed("request_id", "_given_id")
                          .withColumn("request_id", F.expr("uuid()")), "mm-batch")
    given = checked.select("request_id", "_given_id")
    routed = route_requests(checked.drop("_given_id"))

    def named(rows):
        return (rows.join(given, "request_id").drop("request_id")
                .withColumnRenamed("_given_id", "request_id").select(*rows.columns))

    columns = [*RESPONSE, "image_url", "image_id"]
    imaged = lambda rows: rows.withColumns({c: F.lit("") for c in columns[-2:]}).select(*columns)
    start = time.perf_counter()
    found = cut_lineage(answer_mm(routed["query"].select("request_id", "model", "part"), entries, embed, gate, **search),
                        "mm-responses")
    times = {"search": time.perf_counter() - start}
    answered = found.withColumn("status", F.lit("")).select(*columns)

    rows, rejects = mm_entries(routed["insert"].select("request_id", "model", "part", "answer")
                               .where("part is not null and answer is not null"), embed, at)
    rows = cut_lineage(rows, "mm-new")
    rejects = cut_lineage(rejects, "mm-rejects").withColumnRenamed("error_desc", "_why")
    no_pair = F.col("part").isNull() | F.col("answer").isNull()
    why = F.when(no_pair, "no chat_info").otherwise(F.coalesce("_why", F.lit("")))
    inserted = plain(routed["insert"].join(rejects, "request_id", "left"),
                     F.when(why != "", S.INSERT_FAILED).otherwise(S.OK), why,
                     F.when(why != "", "exception").otherwise("success"))

    status = M.remove_status(routed["remove"], entries)
    removed = plain(status, F.col("error_code"), F.lit(""), F.col("status"))

    wanted = routed["register"].select("request_id", "model", mm_type(F.col("kind")).alias("mm_type"))
    usable = F.col("mm_type").isNotNull()
    result, known = M.register_collections(wanted.where(usable).select("model", "mm_type").unionByName(
        rows.select("model", "mm_type")), collections, dim, gate.metric)
    registered = wanted.where(usable).join(result, ["model", "mm_type"])
    registered = plain(registered, F.col("error_code"), F.lit(""), F.col("response")).unionByName(
        plain(wanted.where(~usable), F.lit(S.REGISTER_FAILED), F.lit("unknown kind"), F.lit("exception")))

    rejected = plain(routed["rejected"], F.col("error_code"), F.col("error_desc"), F.lit(""))
    responses = answered
    for part in (inserted, removed, registered, rejected):
        responses = responses.unionByName(imaged(part))

    texts = routed["query"].select("request_id", "model", F.to_json("part").alias("query"))
    log = log_rows_of(answered.select(*RESPONSE), texts, rejected, routed["rejected"], at, times)
    after = delete_entries(M.apply_hit_counts(entries, found, at), routed["remove"])
    after = M.insert_entries(after, rows, at=at)
    return Outcome(named(responses), named(log), after.select(*entries.columns), known, times,
                   {"hits": found, "removes": routed["remove"], "inserts": rows},
                   without_truncated(query_log, routed["remove"], log))
