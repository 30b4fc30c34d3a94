"""Whole lookups: search, gate, fetch, pick, respond."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.functions.ranking import COSINE, Gate, evaluated_question
from answerlake.operators.gate import length_gate, pick_all, pick_first, pick_random, rerank, score_gate
from answerlake.operators.lookup import scalar_fetch
from answerlake.operators.vector_join import knn, small_batch
from answerlake.runtime import BROADCAST_ROWS, cut_lineage, few_rows


def build_response(requests: DataFrame, picked: DataFrame, extra=()) -> DataFrame:
    """One response row per request: hit, miss, or the error it already carries.

    ``requests`` may have ``error_code`` and ``error_desc``; ``picked`` has
    request_id, id, rank, question, answer and the ``extra`` columns.
    """
    asked = requests
    if "error_code" not in asked.columns:
        asked = asked.withColumn("error_code", F.lit(S.OK))
    if "error_desc" not in asked.columns:
        asked = asked.withColumn("error_desc", F.lit(""))
    found = picked.select("request_id", F.col("id").alias("hit_id"), "rank",
                          F.col("question").alias("hit_query"), "answer", *extra)
    out = asked.select("request_id", "error_code", "error_desc").join(found, "request_id", "left")
    hit = F.col("hit_id").isNotNull() & (F.col("error_code") == S.OK)
    text = lambda c: F.when(hit, F.coalesce(F.col(c), F.lit(""))).otherwise("").alias(c)
    return out.select(
        "request_id", "error_code", "error_desc", hit.alias("cache_hit"),
        F.when(hit, F.col("hit_id")).alias("hit_id"), F.when(hit, F.col("rank")).alias("rank"),
        text("hit_query"), text("answer"), *[text(c) for c in extra])


def cache_lookup(requests: DataFrame, entries: DataFrame, gate: Gate = Gate(), k: int = 1,
                 by=("model",), pick: str = "first", seed=0, extra=(), method: str = "auto",
                 scorer: Column = None, **search) -> DataFrame:
    """Answer (request_id, model, key, embedding) rows from the live entries.

    Only ids and vectors take part in the search, and tasks return only
    candidates that can pass the gate; question and answer are fetched for the
    candidates picked. A small request batch is
    broadcast throughout and entries are never shuffled. For a large one the
    gated candidates are written out, so the search runs once, and their count
    decides how entries are fetched. With ``pick="all"`` every request has a row
    with the lists of its candidates, which are empty for a miss.

    ``scorer`` is a caller's evaluator: a rank made from the columns key, question,
    answer, score and rank of each fetched candidate. It replaces the rank, the gate is
    applied again, and the pick is made among what passes. If requests and entries both have
    a column ``deps`` (dependent questions: name, data, dep_type), the scorer sees the first
    one's data as key and question wherever both sides of a pair have any.
    """
    deps = ["deps"] if scorer is not None and "deps" in requests.columns and "deps" in entries.columns else []
    live = entries.where(~F.col("is_deleted"))
    batch = None if method == "tiles" else small_batch(requests, by)
    if batch is None and method == "scan":
        raise ValueError("request batch too large to broadcast")
    near = knn(requests, live, k, gate.metric, by, batch=batch,
               method="tiles" if batch is None else "scan", max_cost=gate.max_cost(), **search)
    gated = score_gate(near.select(*by, "request_id", "id", "score"), gate, by=by).drop(*by[1:])
    lengths = requests.select("request_id", F.char_length("key").alias("_length"))
    bounded = batch is not None and batch.num_rows * k <= BROADCAST_ROWS
    # ids and scores of a bounded batch; entry text is never broadcast
    gated = lengths.join(F.broadcast(gated) if bounded else gated, "request_id")
    kept = length_gate(gated, gate, length="_length").drop("_length")

    def picked(rows):
        if pick == "random":
            return pick_random(rows, seed)
        return pick_first(rows) if pick != "all" and k > 1 else rows

    if scorer is None:
        kept = picked(kept)
    if not bounded:
        kept = cut_lineage(kept, "candidates")
        bounded = few_rows(kept)
    fetched = scalar_fetch(kept, entries, columns=("question", "answer", *extra, *deps), bounded=bounded,
                           by=by[:1])
    if scorer is not None:
        asked = requests.select("request_id", "key", F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in deps])
        pairs = fetched.join(asked, "request_id").withColumn("_question", F.col("question"))
        if deps:
            pairs = pairs.withColumns({
                "key": evaluated_question(F.col("_deps"), F.col("deps"), F.col("key")),
                "question": evaluated_question(F.col("deps"), F.col("_deps"), F.col("question"))})
        # lengths are those of the whole key
        passed = rerank(pairs, scorer, gate, "_key").withColumn("question", F.col("_question"))
        fetched = picked(passed.drop("_key", "_question", "_deps", "deps"))
    if pick == "all":
        none = F.array().cast("array<string>")
        lists = [F.coalesce(c, none).alias(c) for c in ("ids", "questions", "answers")]
        return requests.select("request_id").join(pick_all(fetched), "request_id", "left").select("request_id", *lists)
    return build_response(requests, fetched, extra)


def cache_lookup_cosine(requests: DataFrame, entries: DataFrame, gate: Gate = COSINE,
                        **options) -> DataFrame:
    return cache_lookup(requests, entries, gate, **options)


def cache_lookup_mm(requests: DataFrame, entries: DataFrame,
                    gate: Gate = Gate(short_text=S.SHORT_MM_TEXT), **options) -> DataFrame:
    """Lookup inside (tenant, kind); the response adds image url and id."""
    return cache_lookup(requests, entries, gate, by=("model", "mm_type"),
                        extra=("image_url", "image_id"), **options)
