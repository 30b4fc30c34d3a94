"""From a conversation table (conv_id, turn, role, text) to requests and pairs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 256


def assemble_messages(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation with its messages in order, ``query``.

    Messages are first collected in segments of consecutive turns, so sorting
    and collecting a long conversation is spread over tasks; the request itself
    is one row by definition.
    """
    message = F.struct("turn", "role", F.col("text").alias("content"))
    parts = (turns.groupBy(conv, F.floor(F.col("turn") / SEGMENT).alias("segment"))
             .agg(F.array_sort(F.collect_list(message)).alias("messages")))
    whole = parts.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct("segment", "messages"))).alias("parts"))
    return whole.select(conv, F.transform(
        F.flatten(F.col("parts.messages")),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("query"))


def last_message(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Role and text of the last turn, by partial aggregation."""
    return (turns.groupBy(conv).agg(F.max(F.struct("turn", "role", "text")).alias("m"))
            .select(conv, "m.turn", "m.role", "m.text"))


def pairs_from_conversations(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """User turns followed by an assistant turn, as (key, question, answer).

    Turns count up by one inside a conversation, so the next turn is an
    equi-join on (conversation, turn), which spreads a long conversation; a
    window would sort it in one task.
    """
    asked = turns.where(F.col("role") == "user")
    answers = turns.where(F.col("role") == "assistant").select(
        conv, (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answers, [conv, "turn"]).select(
        conv, "turn", F.concat("role", F.lit(": "), "text").alias("key"),
        F.col("text").alias("question"), "answer")


def dialog_pairs(turns: DataFrame, history: int, conv: str = "conv_id") -> DataFrame:
    """User turns followed by an assistant turn, as (query, answer), where
    ``query`` also holds up to ``history`` earlier messages of the dialogue.

    Every message is sent to the turns it belongs to, so a group holds at most
    ``history + 1`` messages and long conversations stay spread.
    """
    targets = turns.select(
        conv, F.explode(F.sequence(F.col("turn"), F.col("turn") + history)).alias("target"),
        F.struct("turn", "role", F.col("text").alias("content")).alias("message"))
    pairs = pairs_from_conversations(turns, conv).select(conv, F.col("turn").alias("target"), "answer")
    return (targets.join(pairs, [conv, "target"])
            .groupBy(conv, F.col("target").alias("turn"))
            .agg(F.array_sort(F.collect_list("message")).alias("m"), F.first("answer").alias("answer"))
            .select(conv, "turn", F.transform("m", lambda x: F.struct(
                x["role"].alias("role"), x["content"].alias("content"))).alias("query"), "answer"))
