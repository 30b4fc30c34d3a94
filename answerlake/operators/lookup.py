"""Exact lookups, fetching by id, and tiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.runtime import cut_lineage, few_rows, hot_join


def latest_per_key(rows: DataFrame, keys: list, seq: str) -> DataFrame:
    """Last write of each key; partial aggregation, so a hot key does not hurt."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    return (rows.groupBy(*keys)
            .agg(F.max(F.struct(seq, *rest)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (seq, *rest)]))


def exact_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry whose question equals the request's key, in the same tenant.

    Equal questions keep the smallest id; they are aggregated before the
    shuffle. One key may make up much of the requests.
    """
    on = ["model", "key"]
    stored = entries.select("model", F.col("question").alias("key"), "id", "answer")

    def smallest_id(rows):
        return (rows.groupBy(*on).agg(F.min(F.struct("id", "answer")).alias("e"))
                .select(*on, F.col("e.id").alias("hit_id"), F.col("e.answer").alias("answer")))

    return hot_join(requests, stored, on, "left", spread=["request_id"], reduce=smallest_id)


def keep_wanted(rows: DataFrame, wanted: DataFrame, on: list) -> DataFrame:
    """Rows whose key is wanted, when the keys are few enough to broadcast; else
    all rows, left to a later join."""
    if few_rows(wanted):
        return rows.join(F.broadcast(wanted), on, "left_semi")
    return rows


def scalar_fetch(candidates: DataFrame, entries: DataFrame, id_col: str = "id",
                 columns=("question", "answer"), bounded: bool = False, by=()) -> DataFrame:
    """Entry columns for candidate ids; ids without a live entry are dropped.

    ``by`` names columns that the candidates have too, such as the tenant by which the
    table's folders are laid out: only folders of candidates are then read.

    ``bounded`` candidates (known to fit the broadcast bound) are broadcast to
    the entry scan; otherwise one entry may answer a third of all requests.
    """
    live, on = entries.where(~F.col("is_deleted")).select(*by, id_col, *columns), [*by, id_col]
    if bounded:
        return live.join(F.broadcast(candidates), on)
    return hot_join(candidates, live, on, "inner", spread=["request_id"])


def existing_ids(ids: DataFrame, entries: DataFrame, id_col: str = "id") -> DataFrame:
    """Those of the given ids that the table holds."""
    return ids.select(id_col).distinct().join(entries.select(id_col), id_col, "left_semi")


def two_tier_lookup(requests: DataFrame, entries: DataFrame, next_tier) -> DataFrame:
    """Exact tier first; only its misses go to ``next_tier(misses)``.

    ``next_tier`` returns (request_id, hit_id, answer) rows for its hits.
    """
    first = cut_lineage(exact_lookup(requests, entries).select("request_id", "hit_id", "answer"),
                        "first-tier")
    hits = first.where(F.col("hit_id").isNotNull())
    misses = requests.join(hits.select("request_id"), "request_id", "left_anti")
    second = next_tier(misses).select("request_id", "hit_id", "answer",
                                      F.lit("second").alias("tier"))
    return hits.select("request_id", "hit_id", "answer", F.lit("first").alias("tier")).unionByName(
        second)
