"""Request lines and payloads to typed rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake import schema as S


def parse_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON request lines to typed columns; broken lines carry error 400."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.withColumn("_r", F.from_json(value, S.REQUEST, options))
    broken = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    keep = [c for c in lines.columns if c != value]
    return parsed.select(
        *keep, F.col("_r.requestId").alias("request_id"), F.col("_r.type").alias("type"),
        F.col("_r.scope.model").alias("raw_model"), F.col("_r.scope").isNotNull().alias("has_scope"),
        F.col("_r.query").alias("query"),
        F.col("_r.chat_info").alias("chat_info"), F.col("_r.remove_type").alias("remove_type"),
        F.col("_r.id_list").alias("id_list"),
        F.when(broken, S.BAD_REQUEST).otherwise(S.OK).alias("error_code"))


def parse_mm_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """Multimodal request lines to typed columns; broken lines carry error 301.

    ``kind`` is the kind named by a register request; ``part`` is the query of a
    query request or of the last pair of an insert request.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.withColumn("_r", F.from_json(value, S.MM_REQUEST, options))
    broken = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    last = F.try_element_at(F.col("_r.chat_info"), F.lit(-1))
    keep = [c for c in lines.columns if c != value]
    return parsed.select(
        *keep, F.col("_r.UUID").alias("request_id"), F.col("_r.request_type").alias("type"),
        F.col("_r.scope.model").alias("raw_model"), F.col("_r.scope").isNotNull().alias("has_scope"),
        F.col("_r.type").alias("kind"),
        F.when(F.col("_r.request_type") == "insert", last["query"])
        .otherwise(F.col("_r.query")).alias("part"),
        last["answer"].alias("answer"), F.col("_r.remove_type").alias("remove_type"),
        F.col("_r.id_list").alias("id_list"),
        F.when(broken, S.INSERT_FAILED).otherwise(S.OK).alias("error_code"))


def read_requests(spark, path: str) -> DataFrame:
    """Request lines from text files, parsed with the declared schema."""
    return parse_requests(spark.read.text(path))


def explode_chat_info(requests: DataFrame) -> DataFrame:
    """One row per (query, answer) of a bulk insert, with its place ``pos``."""
    rest = [c for c in requests.columns if c != "chat_info"]
    return (requests.select(*rest, F.posexplode("chat_info").alias("pos", "chat"))
            .select(*rest, "pos", F.col("chat.query").alias("chat_query"),
                    F.col("chat.answer").alias("answer")))


ANSWERS = "array<struct<answer:string,answer_type:int>>"


def normalize_answers(text: Column, texts: Column = None, typed: Column = None) -> Column:
    """Answers given as a text, a list of texts, or (answer, type) pairs, to one
    list of (answer, answer_type); the first non-null form is taken, type 0 by
    default."""
    item = lambda a, kind: F.struct(a.alias("answer"), kind.cast("int").alias("answer_type"))
    zero = F.lit(S.ANSWER_TEXT)
    forms = []
    if typed is not None:
        forms.append(F.transform(typed, lambda p: item(
            p["answer"], F.coalesce(p["answer_type"], zero))))
    if texts is not None:
        forms.append(F.transform(texts, lambda a: item(a, zero)))
    forms.append(F.when(text.isNotNull(), F.array(item(text, zero))))
    return F.coalesce(*[f.cast(ANSWERS) for f in forms])
