"""A whole request batch over text entries."""

from pyspark.sql import functions as F

from answerlake.operators import embed as E
from answerlake.operators import maintain as M
from answerlake.plans.mm_requests import answer_mm, handle_mm_requests, mm_entries
from answerlake.plans.requests import handle_requests
from answerlake.runtime import cut_lineage
from answerlake.sources.requests import parse_mm_requests, parse_requests
from registry import query
from registry import tables as t
from registry.embedding import DIM, sql_tokens, unit
from registry.maintenance import at
from registry.shaping import _CODES, MM, mm_requests
from registry.sources import request_lines


def _outcome(spark, sf, query_log=None):
    turns = t.read(spark, sf, "conversations")
    said = turns.select(F.explode(E.tokens(F.concat("role", F.lit(": "), "text"))).alias("token"))
    vectors = cut_lineage(said.distinct().withColumn("vec", unit(F.col("token"))), "token-vectors")

    def embed(rows):
        keyed = rows.withColumn("_row", F.unhex(F.sha2(F.col("key"), 256)))
        one = keyed.select("_row", "key").dropDuplicates(["_row"])
        return keyed.join(E.embed_token_mean(one, "_row", "key", vectors, DIM), "_row").drop("_row")

    model = t.normalize_model(t.tenant(F.col("conv_id")))
    stored = embed(t.pairs(spark, sf).select(model.alias("model"), "key", "answer"))
    entries = cut_lineage(M.new_entries(stored.withColumnRenamed("key", "question"), at=at())
                          .dropDuplicates(["id"]), "entries")
    collections = (entries.where("model <> 'images_test'").groupBy("model", "mm_type").agg(F.lit(1))
                   .select("model", "mm_type", F.lit(DIM).alias("dim"), F.lit("l2").alias("metric")))
    return handle_requests(parse_requests(request_lines(spark, sf)), entries, collections, embed,
                           DIM, at=at(), query_log=query_log)


_BATCH = f"""WITH {_CODES},
lines AS (SELECT b.request_id, b.type, b.model, r.remove_type,
    (CASE WHEN r.conv_id % 7 = 3 THEN 400 ELSE b.error_code END)::INTEGER AS error_code, r.conv_id
  FROM barred b JOIN requests r ON b.request_id = r.request_id),
msgs AS (SELECT conv_id || ':' || turn AS ref, conv_id, turn, role || ': ' || text AS text FROM conversations),
{sql_tokens('msgs', 'ref')},
means AS (SELECT ref, list(x ORDER BY pos) AS v FROM (SELECT w.ref, d.pos, avg(d.x) AS x
  FROM words w JOIN dims d ON w.token = d.token GROUP BY ALL) GROUP BY ref),
units AS (SELECT ref, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM means),
{t.PAIRS},
stored AS (SELECT DISTINCT {t.sql_norm(t.sql_tenant('p.conv_id'))} AS model, p.key, p.answer
  FROM pairs p),
vectors AS (SELECT m.text AS key, any_value(u.v) AS v FROM msgs m JOIN units u ON m.ref = u.ref GROUP BY m.text),
asked AS (SELECT l.request_id, l.model, arg_max(m.text, m.turn) AS key FROM lines l JOIN msgs m ON l.conv_id = m.conv_id
  WHERE l.type = 'query' AND l.error_code = 0 GROUP BY ALL),
best AS (SELECT a.request_id, 4 - least(min(pow(list_distance(q.v, e.v::FLOAT[]::DOUBLE[]), 2)), 4) AS rank
  FROM asked a JOIN vectors q ON a.key = q.key JOIN stored s ON a.model = s.model JOIN vectors e ON s.key = e.key
  GROUP BY a.request_id),
truncated AS (SELECT DISTINCT model FROM lines WHERE type = 'remove' AND error_code = 0 AND remove_type = 'truncate_by_model')"""


@query("handle_requests", f"""{_BATCH}
SELECT CASE WHEN l.error_code <> 400 THEN l.request_id END AS request_id, l.error_code,
  coalesce(b.rank >= 3.8, false) AS cache_hit, CASE WHEN b.rank >= 3.8 THEN round(b.rank, 5) END AS rank,
  CASE WHEN l.error_code <> 0 THEN '' WHEN l.type IN ('insert', 'remove') THEN 'success'
    WHEN l.type = 'register' AND l.model = 'images_test' THEN 'create_success'
    WHEN l.type = 'register' THEN 'already_exists' ELSE '' END AS status
FROM lines l LEFT JOIN best b ON l.request_id = b.request_id""")
def handle(spark, sf):
    return _outcome(spark, sf).responses.select(
        "request_id", "error_code", "cache_hit", F.round("rank", 5).alias("rank"), "status")


@query("entries_after_requests", f"""{_BATCH},
added AS (SELECT DISTINCT l.model, arg_max(m.text, m.turn) AS key, 'answer ' || l.request_id AS answer
  FROM lines l JOIN msgs m ON l.conv_id = m.conv_id WHERE l.type = 'insert' AND l.error_code = 0
  GROUP BY l.request_id, l.model)
SELECT model, question, answer FROM (
  SELECT model, key AS question, answer FROM stored WHERE model NOT IN (SELECT model FROM truncated)
  UNION ALL SELECT * FROM added)""")
def entries_after(spark, sf):
    return _outcome(spark, sf).entries.select("model", "question", "answer")


@query("log_after_requests", f"""{_BATCH}
SELECT l.request_id, l.error_code, coalesce(b.rank >= 3.8, false) AS cache_hit, l.model
FROM lines l LEFT JOIN best b ON l.request_id = b.request_id
WHERE l.error_code = 102 OR (l.type = 'query' AND l.error_code = 0)""")
def log_after(spark, sf):
    return _outcome(spark, sf).log.select("request_id", "error_code", "cache_hit", "model")


@query("log_after_truncate", f"""{_BATCH}, {t.LOG}
SELECT model, count(*) AS rows FROM (SELECT model FROM query_log WHERE model NOT IN (SELECT model FROM truncated)
  UNION ALL SELECT model FROM lines WHERE error_code = 102 OR (type = 'query' AND error_code = 0)) GROUP BY model""")
def log_after_truncate(spark, sf):
    log = t.query_log(spark, sf).drop("user_id")
    return _outcome(spark, sf, log).query_log.groupBy("model").agg(F.count(F.lit(1)).alias("rows"))


@query("collections_after_requests", f"""{_BATCH}
SELECT DISTINCT model FROM stored WHERE model <> 'images_test'
UNION SELECT model FROM lines WHERE type IN ('register', 'insert') AND error_code = 0""")
def collections_after(spark, sf):
    return _outcome(spark, sf).collections.select("model")


# --- multimodal: every benchmark text is inserted and asked for ---

def _mm_lines(spark, sf, verb):
    """JSON lines of one verb; every ninth is broken."""
    r = mm_requests(spark, sf)
    part = F.struct("text", "imageRaw", "imageUrl", F.concat(F.lit("img"), "item_id").alias("imageId"),
                    "multiType")
    body = {"query": part.alias("query"),
            "insert": F.array(F.struct(part.alias("query"), F.concat(F.lit("a"), "item_id").alias("answer")))
            .alias("chat_info")}[verb]
    line = F.to_json(F.struct(F.col("item_id").cast("string").alias("UUID"),
                              F.lit(verb).alias("request_type"),
                              F.struct("model").alias("scope"), body))
    return r.select(F.when(F.col("item_id") % 9 == 4, F.concat(F.lit("["), line)).otherwise(line).alias("value"))


def _mm_parsed(spark, sf, verb):
    good = parse_mm_requests(_mm_lines(spark, sf, verb)).where("error_code = 0")
    return good.withColumn("model", t.normalize_model(F.col("raw_model")))


def _mm_embed(rows):
    """Hash vectors of the image and of the key; an empty key has none."""
    return (rows.withColumn("image_vec", F.when(F.col("image").isNotNull(), unit(F.col("image"))))
            .withColumn("text_vec", F.when(F.col("key") != "", unit(F.col("key")))))


_MM = f"""WITH {MM},
good AS (SELECT *, CASE WHEN url THEN 'http://img/' || item_id WHEN raw THEN 'raw' || item_id END AS image
  FROM mm_requests WHERE item_id % 9 <> 4),
inserts AS (SELECT item_id, model, key, image, image AS used, CASE WHEN url THEN 'http://img/' || item_id ELSE '' END AS image_url,
    url AND raw OR (NOT url AND NOT raw AND key = '') AS bad FROM good),
asks AS (SELECT item_id, model, key, CASE WHEN kind = 'IMG_TEXT' THEN image END AS used, kind,
    (kind = 'IMG_TEXT' AND (url = raw)) OR kind = 'OTHER' OR (kind = 'TEXT' AND key = '') AS bad FROM good),
dim AS (SELECT d::INTEGER AS d FROM range(0, {DIM}) r(d)),
texts AS (SELECT DISTINCT key AS x FROM good UNION SELECT DISTINCT image FROM good),
vec AS (SELECT x, list(('0x' || substr(md5(x || ':' || d), 1, 4))::INTEGER / 65535.0::DOUBLE * 2 - 1 ORDER BY d) AS v
  FROM texts, dim WHERE x IS NOT NULL AND x <> '' GROUP BY x),
stored AS (SELECT i.*, CASE WHEN i.used IS NOT NULL AND key <> '' THEN 'mm' WHEN i.used IS NOT NULL THEN 'image' ELSE 'text' END AS mm_type,
    list_concat(coalesce(a.v, []), coalesce(b.v, [])) AS v
  FROM inserts i LEFT JOIN vec a ON i.used = a.x LEFT JOIN vec b ON i.key = b.x WHERE NOT bad),
asked AS (SELECT i.*, CASE kind WHEN 'IMG_TEXT' THEN 'mm' ELSE 'text' END AS mm_type,
    list_concat(coalesce(a.v, []), coalesce(b.v, [])) AS v
  FROM asks i LEFT JOIN vec a ON i.used = a.x LEFT JOIN vec b ON i.key = b.x WHERE NOT bad),
stored_unit AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))::FLOAT[]::DOUBLE[] AS u FROM stored),
asked_unit AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM asked),
best AS (SELECT q.item_id, 4 - least(min(pow(list_distance(q.u, s.u), 2)), 4) AS rank,
    arg_min(s.image_url, list_distance(q.u, s.u)) AS image_url, arg_min(s.item_id, list_distance(q.u, s.u)) AS hit
  FROM asked_unit q JOIN stored_unit s ON q.model = s.model AND q.mm_type = s.mm_type AND len(q.u) = len(s.u)
  GROUP BY q.item_id)"""


@query("mm_entries", f"""{_MM}
SELECT model, key AS question, 'a' || item_id AS answer, mm_type, image_url, 'img' || item_id AS image_id,
  len(v)::INTEGER AS dim FROM stored""")
def mm_inserted(spark, sf):
    rows, _ = mm_entries(_mm_parsed(spark, sf, "insert"), _mm_embed, at())
    return rows.select("model", "question", "answer", "mm_type", "image_url", "image_id",
                       F.size("embedding").alias("dim"))


@query("answer_mm", f"""{_MM}
SELECT a.item_id::VARCHAR AS request_id, (CASE WHEN a.bad THEN 201 ELSE 0 END)::INTEGER AS error_code,
  coalesce(b.rank >= 3.8, false) AS cache_hit, CASE WHEN b.rank >= 3.8 THEN round(b.rank, 5) END AS rank,
  CASE WHEN b.rank >= 3.8 THEN b.image_url ELSE '' END AS image_url,
  CASE WHEN b.rank >= 3.8 THEN 'a' || b.hit ELSE '' END AS answer
FROM asks a LEFT JOIN best b ON a.item_id = b.item_id""")
def answered_mm(spark, sf):
    rows, _ = mm_entries(_mm_parsed(spark, sf, "insert"), _mm_embed, at())
    out = answer_mm(_mm_parsed(spark, sf, "query"), cut_lineage(rows, "mm-entries"), _mm_embed)
    return out.select("request_id", "error_code", "cache_hit", F.round("rank", 5).alias("rank"),
                      "image_url", "answer")


def _mm_outcome(spark, sf):
    """Everything is stored, then asked for, and inserted again with other answers."""
    rows, _ = mm_entries(_mm_parsed(spark, sf, "insert"), _mm_embed, at())
    again = _mm_parsed(spark, sf, "insert").withColumns({
        "request_id": F.concat(F.lit("i"), "request_id"), "answer": F.concat(F.lit("b"), F.substring("answer", 2, 20))})
    none = spark.createDataFrame([], "model string, mm_type string, dim int, metric string")
    return handle_mm_requests(_mm_parsed(spark, sf, "query").unionByName(again), cut_lineage(rows, "mm-entries"),
                              none, _mm_embed, DIM, at=at())


@query("handle_mm_requests", f"""{_MM}
SELECT a.item_id::VARCHAR AS request_id, (CASE WHEN a.bad THEN 201 ELSE 0 END)::INTEGER AS error_code,
  coalesce(b.rank >= 3.8, false) AS cache_hit, CASE WHEN b.rank >= 3.8 THEN 'a' || b.hit ELSE '' END AS answer, '' AS status
FROM asks a LEFT JOIN best b ON a.item_id = b.item_id
UNION ALL SELECT 'i' || item_id, (CASE WHEN bad THEN 301 ELSE 0 END)::INTEGER, false, '',
  CASE WHEN bad THEN 'exception' ELSE 'success' END FROM inserts""")
def handled_mm(spark, sf):
    return _mm_outcome(spark, sf).responses.select("request_id", "error_code", "cache_hit", "answer", "status")


@query("mm_entries_after", f"""{_MM},
hits AS (SELECT hit, count(*) AS n FROM best WHERE rank >= 3.8 GROUP BY hit)
SELECT model, key AS question, 'a' || item_id AS answer, mm_type, image_url, coalesce(n, 0)::BIGINT AS hit_count, {t.sql_digest('u')}
FROM stored_unit LEFT JOIN hits ON hit = item_id
UNION ALL SELECT model, key, 'b' || item_id, mm_type, image_url, 0, {t.sql_digest('u')} FROM stored_unit""")
def mm_entries_after(spark, sf):
    return _mm_outcome(spark, sf).entries.select("model", "question", "answer", "mm_type", "image_url", "hit_count",
                                                 *t.vector_digest())


@query("mm_log_after", f"""{_MM}
SELECT a.item_id::VARCHAR AS request_id, (CASE WHEN a.bad THEN 201 ELSE 0 END)::INTEGER AS error_code,
  coalesce(b.rank >= 3.8, false) AS cache_hit, a.model FROM asks a LEFT JOIN best b ON a.item_id = b.item_id""")
def mm_log_after(spark, sf):
    return _mm_outcome(spark, sf).log.select("request_id", "error_code", "cache_hit", "model")
