"""From scored candidates to the chosen answer."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlake.functions.ranking import Gate


def score_gate(candidates: DataFrame, gate: Gate, request_id: str = "request_id",
               by=()) -> DataFrame:
    """Candidates of requests whose best rank reaches the short threshold.

    Adds ``rank``. This runs before entries are fetched and needs only scores.
    Naming the search's group columns in ``by`` reuses its partitioning.
    """
    short, _ = gate.cuts()
    best = Window.partitionBy(*by, request_id)
    return (candidates.withColumn("rank", gate.rank(F.col("score")))
            .withColumn("_best", F.max("rank").over(best))
            .where(F.col("_best") >= short).drop("_best"))


def length_gate(candidates: DataFrame, gate: Gate, key: str = "key",
                length: str = None) -> DataFrame:
    """Candidates whose own rank reaches the threshold of the request's length
    class; ``length`` names a column that already holds the key's length."""
    short, long = gate.cuts()
    size = F.col(length) if length else F.char_length(F.col(key))
    return candidates.where(
        F.col("rank") >= F.when(size <= gate.short_text, short).otherwise(long))


def rerank(candidates: DataFrame, scorer: Column, gate: Gate, key: str = "key") -> DataFrame:
    """Replace ``rank`` by a pair score and filter with the same length rule."""
    return length_gate(candidates.withColumn("rank", scorer), gate, key)


def _best_first(id_col):
    return [F.col("rank").desc(), F.col(id_col)]


def sort_candidates(candidates: DataFrame, request_id: str = "request_id",
                    id_col: str = "id") -> DataFrame:
    """Number a request's candidates by falling rank, ties by id."""
    w = Window.partitionBy(request_id).orderBy(*_best_first(id_col))
    return candidates.withColumn("place", F.row_number().over(w))


def _pick(candidates, request_id, key):
    rest = [c for c in candidates.columns if c != request_id]
    return (candidates.groupBy(request_id)
            .agg(F.min(F.struct(key.alias("_k"), *[F.col(c) for c in rest])).alias("_b"))
            .select(request_id, *[F.col(f"_b.{c}").alias(c) for c in rest]))


def pick_first(candidates: DataFrame, request_id: str = "request_id",
               id_col: str = "id") -> DataFrame:
    """Best candidate of each request."""
    return _pick(candidates, request_id,
                 F.struct((-F.col("rank")).alias("r"), F.col(id_col).alias("i")))


def pick_random(candidates: DataFrame, seed, request_id: str = "request_id",
                id_col: str = "id") -> DataFrame:
    """One candidate of each request, at random but repeatable for a seed."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(request_id), F.col(id_col)))
    return _pick(candidates, request_id, F.struct(draw.alias("d"), F.col(id_col).alias("i")))


def pick_all(candidates: DataFrame, request_id: str = "request_id",
             id_col: str = "id") -> DataFrame:
    """All candidates of each request as lists, best first; at most k rows a request."""
    row = F.struct((-F.col("rank")).alias("o"), F.col(id_col).alias("id"),
                   F.col("question").alias("question"), F.col("answer").alias("answer"))
    return (candidates.groupBy(request_id)
            .agg(F.array_sort(F.collect_list(row)).alias("c"))
            .select(request_id, F.col("c.id").alias("ids"),
                    F.col("c.question").alias("questions"), F.col("c.answer").alias("answers")))
