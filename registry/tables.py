"""Tables derived from the given parquet, in Spark and in SQL."""

from pyspark.sql import functions as F

from answerlake.functions import vectors as V
from answerlake.functions.text import normalize_model

# Tenants by id, before normalising; the last one is on the blacklist.
TENANTS = ("team-a.1", "team-b.2", "images.test", "DI_COPILOT_LAB")


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector_digest(c="embedding"):
    """First, last and weighted sum of a vector, for comparison with SQL."""
    wide = lambda x: x.cast("double")
    total = F.aggregate(F.transform(F.col(c), lambda x, i: wide(x) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return [F.size(c).alias("dim"), F.round(wide(F.col(c)[0]), 6).alias("v_first"),
            F.round(wide(F.element_at(c, -1)), 6).alias("v_last"), F.round(total, 5).alias("v_sum")]


def sql_digest(v="embedding"):
    wide = f"(({v})::FLOAT[]::DOUBLE[])"
    return f"""len({v})::INTEGER AS dim, round({wide}[1], 6) AS v_first, round({wide}[-1], 6) AS v_last,
  round(list_sum(list_transform({wide}, lambda x, i: x * i)), 5) AS v_sum"""


def tenant(i):
    return F.element_at(F.array(*[F.lit(t) for t in TENANTS]), (i % 4 + 1).cast("int"))


def sql_tenant(i):
    whens = " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(TENANTS[:3]))
    return f"(CASE ({i}) % 4 {whens} ELSE '{TENANTS[3]}' END)"


def sql_norm(text):
    return f"replace(replace({text}, '-', '_'), '.', '_')"


def entries(spark, sf):
    """Entry table over ``embeddings``; label 9 is marked deleted."""
    e = read(spark, sf, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i.cast("string").alias("id"), normalize_model(tenant(i)).alias("model"),
        F.element_at(F.array(F.lit("mm"), F.lit("image"), F.lit("text")),
                     (i.cast("long") % 3 + 1).cast("int")).alias("mm_type"),
        F.concat(F.lit("q"), i).alias("question"), F.concat(F.lit("a"), i).alias("answer"),
        F.lit(0).alias("answer_type"), F.concat(F.lit("http://img/"), i).alias("image_url"),
        F.concat(F.lit("img"), i).alias("image_id"), "embedding",
        F.lit(0).cast("long").alias("hit_count"), (F.col("label") == 9).alias("is_deleted"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, vec_id, 0)").alias("gmt_create"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, vec_id, 0)").alias("gmt_modified"),
        F.col("label").alias("label"))


ENTRIES = f"""entries AS (
  SELECT vec_id::VARCHAR AS id, {sql_norm(sql_tenant('vec_id'))} AS model,
    CASE vec_id % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'image' ELSE 'text' END AS mm_type,
    'q' || vec_id AS question, 'a' || vec_id AS answer, 0::INTEGER AS answer_type,
    'http://img/' || vec_id AS image_url, 'img' || vec_id AS image_id, embedding,
    0::BIGINT AS hit_count, label = 9 AS is_deleted,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS gmt_create,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS gmt_modified, label
  FROM embeddings)"""

# Planted requests: unit vectors between an entry and the next one, in four
# classes of distance. The truth is the entry itself.
MIX = ((1.0, 0.0), (0.8, 0.2), (0.6, 0.4), (0.52, 0.48))


def planted(spark, sf):
    e = read(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    both = e.join(nxt, "vec_id", "left")
    cls = F.expr("cast((vec_id div 4) % 4 as int)")
    weight = lambda j: F.element_at(F.array(*[F.lit(m[j]) for m in MIX]), cls + 1)
    i = F.col("vec_id")
    return both.select(
        F.concat(F.lit("r"), i).alias("request_id"), normalize_model(tenant(i)).alias("model"),
        F.element_at(F.array(F.lit("mm"), F.lit("image"), F.lit("text")),
                     (i % 3 + 1).cast("int")).alias("mm_type"),
        F.concat(F.lit("q"), i, F.expr("repeat('x', cast((vec_id % 5) * 80 as int))")).alias("key"),
        i.cast("string").alias("truth"), cls.alias("class"),
        V.l2_normalize(V.mix(F.col("embedding"), F.coalesce("w", "embedding"),
                             weight(0), weight(1))).alias("embedding"))


_W = lambda j: "CASE c " + " ".join(f"WHEN {n} THEN {m[j]}::DOUBLE" for n, m in enumerate(MIX)) + " END"
PLANTED = f"""mixed AS (
  SELECT a.vec_id, ((a.vec_id // 4) % 4)::INTEGER AS c, a.embedding::DOUBLE[] AS v,
    coalesce(b.embedding, a.embedding)::DOUBLE[] AS w
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1),
weighted AS (
  SELECT vec_id, c, list_transform(list_zip(v, w), lambda t: t[1] * ({_W(0)}) + t[2] * ({_W(1)})) AS s
  FROM mixed),
planted AS (
  SELECT 'r' || vec_id AS request_id, {sql_norm(sql_tenant('vec_id'))} AS model,
    CASE vec_id % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'image' ELSE 'text' END AS mm_type,
    'q' || vec_id || repeat('x', (vec_id % 5) * 80) AS key, vec_id::VARCHAR AS truth,
    c AS class, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS embedding
  FROM weighted)"""


def knn_sql(k, metric="l2", by=("model",), name="near"):
    """All pairs inside a group, numbered by closeness."""
    score = ("pow(list_distance(p.embedding, e.embedding::DOUBLE[]), 2)" if metric == "l2"
             else "list_cosine_similarity(p.embedding, e.embedding::DOUBLE[])")
    order = "score" if metric == "l2" else "score DESC"
    on = " AND ".join(f"p.{c} = e.{c}" for c in by)
    return f"""pairs AS (
  SELECT {', '.join(f'p.{c}' for c in by)}, p.request_id, p.key, p.truth, e.id, {score} AS score
  FROM planted p JOIN entries e ON {on} WHERE NOT e.is_deleted),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}, id)::INTEGER AS position
  FROM pairs QUALIFY position <= {k})"""


def query_log(spark, sf):
    e = read(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("log_id"), "ts",
        F.when(F.col("event_type") == "error", 201).otherwise(0).alias("error_code"),
        F.when(F.col("event_type") == "error", "search failed").otherwise("").alias("error_desc"),
        F.col("event_type").isin("view", "click", "purchase").alias("cache_hit"),
        normalize_model(tenant(F.col("user_id"))).alias("model"),
        F.concat(F.lit("q"), F.get_json_object("props", "$.k")).alias("query"),
        F.when(F.col("event_type").isin("view", "click", "purchase"),
               F.concat(F.lit("q"), F.get_json_object("props", "$.k"))).otherwise("").alias("hit_query"),
        F.when(F.col("event_type").isin("view", "click", "purchase"),
               F.concat(F.lit("a"), F.get_json_object("props", "$.k"))).otherwise("").alias("answer"),
        (F.col("value") / 1000).alias("delta_time"), "user_id")


LOG = f"""query_log AS (
  SELECT event_id AS log_id, ts, (CASE WHEN event_type = 'error' THEN 201 ELSE 0 END)::INTEGER AS error_code,
    CASE WHEN event_type = 'error' THEN 'search failed' ELSE '' END AS error_desc,
    event_type IN ('view', 'click', 'purchase') AS cache_hit,
    {sql_norm(sql_tenant('user_id'))} AS model, 'q' || (props->>'$.k') AS query,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'q' || (props->>'$.k') ELSE '' END AS hit_query,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'a' || (props->>'$.k') ELSE '' END AS answer,
    value / 1000 AS delta_time, user_id
  FROM events)"""


def access_log(spark, sf, wide=True):
    """Accesses by tenant; ``wide`` keys are user and item, else the user alone."""
    e = read(spark, sf, "events")
    key = (F.concat(F.col("user_id"), F.lit(":"), F.get_json_object("props", "$.k")) if wide
           else F.col("user_id").cast("string"))
    return e.select(normalize_model(tenant(F.col("user_id") % 2)).alias("model"), key.alias("key"),
                    F.when(F.col("event_type") == "signup", "put").otherwise("get").alias("op"),
                    F.col("event_id").alias("seq"))


def sql_access(wide=True):
    key = "user_id || ':' || (props->>'$.k')" if wide else "user_id::VARCHAR"
    return f"""access_log AS (
  SELECT {sql_norm(sql_tenant('user_id % 2'))} AS model, {key} AS key,
    CASE WHEN event_type = 'signup' THEN 'put' ELSE 'get' END AS op, event_id AS seq FROM events)"""


def op_times(spark, sf):
    e = read(spark, sf, "events")
    return e.select("ts", normalize_model(tenant(F.col("user_id"))).alias("model"),
                    F.when(F.col("event_type").isin("view", "signup"), "embedding")
                    .otherwise("search").alias("op"), (F.col("value") / 1000).alias("seconds"))


OP_TIMES = f"""op_times AS (
  SELECT ts, {sql_norm(sql_tenant('user_id'))} AS model,
    CASE WHEN event_type IN ('view', 'signup') THEN 'embedding' ELSE 'search' END AS op,
    value / 1000 AS seconds FROM events)"""


def pairs(spark, sf):
    from answerlake.operators.conversations import pairs_from_conversations
    return pairs_from_conversations(read(spark, sf, "conversations"))


PAIRS = """pairs AS (
  SELECT conv_id, turn, role || ': ' || text AS key, text AS question, next_text AS answer
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def messages(spark, sf):
    """One request per conversation: its turns as an ordered message array."""
    from answerlake.operators.conversations import assemble_messages
    return assemble_messages(read(spark, sf, "conversations"))


def typed_requests(spark, sf):
    """One parsed request per conversation, verbs and tenants by id."""
    i = F.col("conv_id")
    verb = F.element_at(F.array(*[F.lit(v) for v in
                                  ("query", "insert", "remove", "register", "bogus", None)]),
                        (i % 6 + 1).cast("int"))
    remove = F.element_at(F.array(F.lit("delete_by_id"), F.lit("truncate_by_model"), F.lit("drop")),
                          (F.expr("conv_id div 6") % 3 + 1).cast("int"))
    return messages(spark, sf).select(
        i.cast("string").alias("request_id"), verb.alias("type"),
        F.when(i % 13 != 0, tenant(i)).alias("raw_model"), (i % 26 != 0).alias("has_scope"),
        remove.alias("remove_type"), "query")


REQUESTS = f"""requests AS (
  SELECT conv_id::VARCHAR AS request_id,
    CASE conv_id % 6 WHEN 0 THEN 'query' WHEN 1 THEN 'insert' WHEN 2 THEN 'remove'
      WHEN 3 THEN 'register' WHEN 4 THEN 'bogus' END AS type,
    CASE WHEN conv_id % 13 <> 0 THEN {sql_tenant('conv_id')} END AS raw_model, conv_id % 26 <> 0 AS has_scope,
    CASE (conv_id // 6) % 3 WHEN 0 THEN 'delete_by_id' WHEN 1 THEN 'truncate_by_model' ELSE 'drop' END AS remove_type,
    count(*) AS n_messages, arg_max(text, turn) AS last_text, arg_max(role, turn) AS last_role,
    conv_id
  FROM conversations GROUP BY conv_id)"""
