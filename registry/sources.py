"""Scans, request parsing, writers."""

from pyspark.sql import functions as F

from answerlake.functions.text import multi_splicing
from answerlake.operators.conversations import dialog_pairs
from answerlake.runtime import number_rows, shared_dir
from answerlake.sources import objects as O
from answerlake.sources import requests as Q
from answerlake.sources import tables as TB
from answerlake.sources import vectors as VB
from registry import query
from registry import tables as t


def _stored_entries(spark, sf):
    """The entry table written per tenant, and its folder."""
    path = shared_dir(spark, "entries")
    from answerlake import schema as S
    TB.write_entries(t.entries(spark, sf).select(*S.ENTRY.names), path)
    return path


_ENTRY_COLS = "id, model, mm_type, question, answer, answer_type, image_url, image_id, hit_count, is_deleted, gmt_create"


@query("scan_entries", f"""WITH {t.ENTRIES}
SELECT id, model, question, answer, gmt_create FROM entries
WHERE NOT is_deleted AND model IN ('team_a_1', 'team_b_2')""")
def scan_entries(spark, sf):
    path = _stored_entries(spark, sf)
    return (TB.read_entries(spark, path, ["team_a_1", "team_b_2"])
            .select("id", "model", "question", "answer", "gmt_create"))


@query("write_entries", f"""WITH {t.ENTRIES}
SELECT {_ENTRY_COLS}, len(embedding)::INTEGER AS dim,
  round(list_sum(embedding::DOUBLE[]), 6) AS total FROM entries""")
def write_entries(spark, sf):
    from answerlake import schema as S
    back = spark.read.schema(S.ENTRY).parquet(_stored_entries(spark, sf))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return back.select(*_ENTRY_COLS.split(", "), F.size("embedding").alias("dim"),
                       F.round(total, 6).alias("total"))


@query("scan_query_log", f"""WITH {t.LOG}
SELECT log_id, ts, error_code, cache_hit, model, query, answer, delta_time
FROM query_log WHERE ts >= TIMESTAMP '2024-01-15'""")
def scan_query_log(spark, sf):
    path = shared_dir(spark, "log")
    TB.append_log(t.query_log(spark, sf).drop("user_id"), path)
    return TB.read_log(spark, path, "2024-01-15").select(
        "log_id", "ts", "error_code", "cache_hit", "model", "query", "answer", "delta_time")


def request_lines(spark, sf):
    """JSON lines of the conversation requests; every seventh one is broken."""
    r = t.typed_requests(spark, sf)
    body = F.to_json(F.struct(
        F.col("request_id").alias("requestId"), "type",
        F.when(F.col("has_scope"), F.struct(F.col("raw_model").alias("model"))).alias("scope"), "query",
        F.array(F.struct("query", F.concat(F.lit("answer "), "request_id").alias("answer")))
        .alias("chat_info"), "remove_type", F.array("request_id").alias("id_list")))
    number = F.col("request_id").cast("long")
    return r.select(number.alias("line"),
                    F.when(number % 7 == 3, F.concat(F.lit("{"), body)).otherwise(body).alias("value"))


@query("parse_requests", f"""WITH {t.REQUESTS}, ok AS (SELECT *, conv_id % 7 <> 3 AS good FROM requests)
SELECT conv_id AS line, (CASE WHEN good THEN 0 ELSE 400 END)::INTEGER AS error_code,
  CASE WHEN good THEN request_id END AS request_id, CASE WHEN good THEN type END AS type,
  CASE WHEN good THEN raw_model END AS raw_model,
  CASE WHEN good THEN n_messages::INTEGER END AS n_messages,
  CASE WHEN good THEN last_text END AS last_text, CASE WHEN good THEN remove_type END AS remove_type
FROM ok""")
def parse_requests(spark, sf):
    parsed = Q.parse_requests(request_lines(spark, sf))
    return parsed.select("line", "error_code", "request_id", "type", "raw_model",
                         F.when(F.col("query").isNotNull(), F.size("query")).alias("n_messages"),
                         F.try_element_at("query", F.lit(-1))["content"].alias("last_text"),
                         "remove_type")


@query("explode_chat_info", """SELECT conv_id::VARCHAR AS request_id,
  (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos,
  role AS chat_role, text AS chat_text, 'answer ' || turn AS answer FROM conversations""")
def explode_chat_info(spark, sf):
    m = t.messages(spark, sf)
    info = F.transform("query", lambda x, i: F.struct(
        F.array(x).alias("query"), F.concat(F.lit("answer "), i).alias("answer")))
    bulk = m.select(F.col("conv_id").cast("string").alias("request_id"), info.alias("chat_info"))
    out = Q.explode_chat_info(bulk)
    return out.select("request_id", "pos", F.col("chat_query")[0]["role"].alias("chat_role"),
                      F.col("chat_query")[0]["content"].alias("chat_text"), "answer")


@query("pairs_from_conversations", f"WITH {t.PAIRS} SELECT * FROM pairs")
def pairs_from_conversations(spark, sf):
    return t.pairs(spark, sf)


@query("pairs_with_history", f"""WITH {t.PAIRS}
SELECT p.conv_id, p.turn, string_agg(c.role || '###' || c.text, '|||' ORDER BY c.turn) AS key, any_value(p.answer) AS answer
FROM pairs p JOIN conversations c ON p.conv_id = c.conv_id AND c.turn BETWEEN p.turn - 2 AND p.turn
GROUP BY p.conv_id, p.turn""")
def pairs_with_history(spark, sf):
    pairs = dialog_pairs(t.read(spark, sf, "conversations"), 2)
    return pairs.select("conv_id", "turn", multi_splicing(F.col("query")).alias("key"), "answer")


@query("decode_vectors", """SELECT vec_id, unnest(embedding) AS value,
  (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos FROM embeddings""")
def decode_vectors(spark, sf):
    raw = VB.encode_vectors(t.read(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return VB.decode_vectors(raw, "embedding", 64).select(
        "vec_id", F.posexplode("embedding").alias("pos", "value"))


@query("append_query_log", f"""WITH {t.LOG}
SELECT log_id::VARCHAR AS request_id, ts, error_code, error_desc, cache_hit, model, query,
  CASE WHEN cache_hit THEN '["' || hit_query || '","' || model || '"]' ELSE '' END AS hit_query,
  answer, delta_time FROM query_log""")
def append_query_log(spark, sf):
    log = t.query_log(spark, sf).withColumn("request_id", F.col("log_id").cast("string"))
    listed = log.withColumn("hit_query", F.when(F.col("cache_hit"), F.array("hit_query", "model")))
    path = shared_dir(spark, "log")
    TB.append_log(TB.log_rows(listed), path)
    return spark.read.parquet(path).drop("day")


_TYPED = """answers AS (SELECT event_id::VARCHAR AS id, event_type, event_type || props AS answer,
  (CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END)::INTEGER AS answer_type FROM events)"""


def _typed_answers(spark, sf):
    kind = F.col("event_type")
    return t.read(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.concat("event_type", "props").alias("answer"),
        F.when(kind == "view", 1).when(kind == "signup", 2).otherwise(0).alias("answer_type"))


@query("externalize_objects", f"""WITH {_TYPED}
SELECT id, CASE WHEN answer_type <> 0 THEN sha256(answer) ELSE answer END AS answer, answer_type,
  CASE WHEN answer_type <> 0 THEN answer END AS payload FROM answers""")
def externalize_objects(spark, sf):
    slim, objects = O.externalize_objects(_typed_answers(spark, sf))
    full = O.get_objects(slim, objects).select("id", F.when(
        F.col("answer_type") != 0, F.col("answer")).alias("payload"))
    return slim.join(full, "id").select("id", "answer", "answer_type", "payload")


@query("object_table", f"""WITH {_TYPED}
SELECT DISTINCT sha256(answer) AS object_key, answer AS payload FROM answers
WHERE answer_type <> 0 AND sha256(answer) NOT IN (SELECT sha256(answer) FROM answers WHERE answer_type = 2)""")
def object_table(spark, sf):
    typed = _typed_answers(spark, sf)
    _, objects = O.externalize_objects(typed)
    gone = typed.where("answer_type = 2").select(F.sha2("answer", 256).alias("object_key"))
    return O.delete_objects(objects, gone)


@query("append_access_log", f"""WITH {t.LOG}, accesses AS (
  SELECT model, answer AS key, 'get' AS op, ts AS "at" FROM query_log WHERE cache_hit
  UNION ALL SELECT model, query, 'put', ts FROM query_log WHERE NOT cache_hit AND error_code = 0
  UNION ALL SELECT model, query, 'put', ts FROM query_log WHERE error_code <> 0)
SELECT *, row_number() OVER (ORDER BY "at", model, key, op) AS place FROM accesses""")
def append_access_log(spark, sf):
    """The log's order is checked through the position of each ``seq``."""
    log = t.query_log(spark, sf)
    rows = lambda cond, col: log.where(cond).select("model", F.col(col).alias("id"), F.col("ts").alias("at"))
    out = TB.access_rows(stored=rows("not cache_hit and error_code = 0", "query"),
                         fetched=rows("cache_hit", "answer"),
                         reloaded=rows("error_code <> 0", "query"))
    path = shared_dir(spark, "access")
    TB.append_access_log(out, path)
    return number_rows(spark.read.parquet(path), [], "seq", "place").drop("seq")


@query("normalize_answers", """SELECT event_id, unnest(CASE event_type
    WHEN 'view' THEN [{'answer': props, 'answer_type': 0}]
    WHEN 'click' THEN [{'answer': props, 'answer_type': 0}, {'answer': user_id::VARCHAR, 'answer_type': 0}]
    ELSE [{'answer': props, 'answer_type': 1}, {'answer': user_id::VARCHAR, 'answer_type': 0}] END, recursive := true)
FROM events""")
def normalize_answers(spark, sf):
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    pair = lambda a, k: F.struct(a.alias("answer"), k.alias("answer_type"))
    answers = Q.normalize_answers(
        F.when(kind == "view", F.col("props")),
        F.when(kind == "click", F.array("props", user)),
        F.when(~kind.isin("view", "click"), F.array(
            pair(F.col("props"), F.lit(1)), pair(user, F.lit(None).cast("int")))))
    return (t.read(spark, sf, "events").select("event_id", F.explode(answers).alias("a"))
            .select("event_id", "a.answer", "a.answer_type"))


def _image_folder(spark, sf):
    """Every benchmark text as one file, so the images grow with the table."""
    path = shared_dir(spark, "images")
    t.read(spark, sf, "benchmark").select(
        F.col("text"), F.col("item_id").alias("item")).write.partitionBy("item").text(path)
    return path


@query("scan_images", """SELECT item_id, (octet_length(encode(text)) + 1)::BIGINT AS length,
  md5(text || chr(10)) AS digest FROM benchmark""")
def scan_images(spark, sf):
    item = F.regexp_extract("path", "item=([0-9]+)", 1).cast("long")
    return O.scan_images(spark, _image_folder(spark, sf)).select(
        item.alias("item_id"), "length", F.md5("content").alias("digest"))


@query("mm_image_question_key", """SELECT item_id,
  base64(encode(text || chr(10))) || 'what is in ' || item_id AS key FROM benchmark""")
def mm_image_question_key(spark, sf):
    images = O.scan_images(spark, _image_folder(spark, sf)).withColumn(
        "name", F.regexp_extract("path", "item=([0-9]+)", 1))
    asked = t.read(spark, sf, "benchmark").select(
        "item_id", F.col("item_id").cast("string").alias("name"),
        F.concat(F.lit("what is in "), "item_id").alias("question"))
    return O.image_question_key(asked, images).select(
        "item_id", F.translate("key", "\r\n", "").alias("key"))
