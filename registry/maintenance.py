"""Entry-table changes."""

from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.operators import embed as E
from answerlake.operators import maintain as M
from answerlake.runtime import shared_dir
from registry import query
from registry import tables as t
from registry.embedding import DIM, sql_tokens, token_vectors



def at():
    return F.expr("timestamp_ntz'2024-02-01 00:00:00'")


_SQL_AT = "TIMESTAMP '2024-02-01 00:00:00'"


def fresh_rows(spark, sf):
    """User questions with their answers, embedded by token mean."""
    p = t.pairs(spark, sf).select(F.concat_ws(":", "conv_id", "turn").alias("ref"), "conv_id",
                                  F.col("question").alias("text"), "key", "answer")
    vectors = E.embed_token_mean(p, "ref", "text", token_vectors(p), DIM)
    return p.join(vectors, "ref").select(
        "ref", F.lit("team_a_1").alias("model"), F.col("key").alias("question"), "answer", "embedding")


_ID = "sha256('team_a_1' || chr(31) || key || chr(31) || answer)"


# new rows with their unit vectors
FRESH = f"""{t.PAIRS}, asked AS (SELECT conv_id || ':' || turn AS ref, question AS text FROM pairs),
{sql_tokens('asked', 'ref')},
means AS (SELECT ref, list(x ORDER BY pos) AS v FROM (SELECT w.ref, d.pos, avg(d.x) AS x
  FROM words w JOIN dims d ON w.token = d.token GROUP BY ALL) GROUP BY ref),
fresh AS (SELECT {_ID} AS id, 'team_a_1' AS model, key AS question, answer,
    any_value(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS embedding
  FROM pairs p JOIN means m ON m.ref = conv_id || ':' || turn GROUP BY ALL)"""


@query("insert_entries", f"""WITH {FRESH}, {t.ENTRIES}
SELECT id, model, question, answer, answer_type, hit_count, is_deleted, {t.sql_digest()} FROM entries
UNION ALL SELECT id, model, question, answer, 0::INTEGER, 0::BIGINT, false, {t.sql_digest()} FROM fresh""")
def insert_entries(spark, sf):
    grown = M.insert_entries(t.entries(spark, sf), fresh_rows(spark, sf), at=at())
    return grown.select("id", "model", "question", "answer", "answer_type", "hit_count",
                        "is_deleted", *t.vector_digest())


@query("assign_ids", f"WITH {t.PAIRS} SELECT conv_id, turn, {_ID} AS id FROM pairs")
def assign_ids(spark, sf):
    rows = t.pairs(spark, sf).select("conv_id", "turn", F.lit("team_a_1").alias("model"),
                                     F.col("key").alias("question"), "answer")
    return M.assign_ids(rows).select("conv_id", "turn", "id")


_ZIP = """sides AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS q,
  list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id),
sized AS (SELECT conv_id, coalesce(q, []) AS q, coalesce(a, []) AS a FROM sides)"""


@query("zip_columns", f"""WITH {_ZIP}
SELECT conv_id, (generate_subscripts(q, 1) - 1)::INTEGER AS pos, unnest(q) AS question, unnest(a) AS answer,
  unnest(list_transform(q, lambda x: length(x)))::INTEGER AS size
FROM sized WHERE len(q) = len(a)""")
def zip_columns(spark, sf):
    good, _ = M.zip_columns(_sides(spark, sf))
    return good.select("conv_id", "pos", "question", "answer", F.col("embedding")[0].alias("size"))


@query("zip_columns_rejects", f"""WITH {_ZIP} SELECT conv_id, len(q)::INTEGER AS questions,
  len(a)::INTEGER AS answers FROM sized WHERE len(q) <> len(a)""")
def zip_columns_rejects(spark, sf):
    _, bad = M.zip_columns(_sides(spark, sf))
    return bad.select("conv_id", F.size("questions").alias("questions"), F.size("answers").alias("answers"))


def _sides(spark, sf):
    side = lambda role: F.transform(F.filter("query", lambda m: m["role"] == role),
                                    lambda m: m["content"])
    return t.messages(spark, sf).select(
        "conv_id", side("user").alias("questions"), side("assistant").alias("answers"),
        F.transform(side("user"), lambda q: F.array(F.char_length(q))).alias("embeddings"))


@query("mm_insert", f"""WITH kinds AS (SELECT vec_id, embedding, CASE WHEN label < 7 AND label <> 1 AND label > 2 THEN 'mm'
    WHEN label < 7 AND label <> 1 THEN 'image' WHEN label > 2 THEN 'text' END AS mm_type FROM embeddings)
SELECT sha256({t.sql_norm(t.sql_tenant('vec_id'))} || chr(31) || 'q' || vec_id || chr(31) || 'a' || vec_id
    || chr(31) || '0=' || mm_type || chr(31) || '1=http://img/' || vec_id || chr(31) || '2=img' || vec_id) AS id,
  mm_type, 'http://img/' || vec_id AS image_url, 'img' || vec_id AS image_id,
  {t.sql_digest("v")} FROM (SELECT *, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS v
    FROM (SELECT *, (CASE mm_type WHEN 'mm' THEN list_concat(embedding, list_reverse(embedding)) WHEN 'text' THEN list_reverse(embedding)
      ELSE embedding END)::DOUBLE[] AS w FROM kinds)) WHERE mm_type IS NOT NULL""")
def mm_insert(spark, sf):
    e = t.entries(spark, sf)
    label = F.col("label")
    rows = e.select("model", "question", "answer", "image_url", "image_id",
                    F.when((label < 7) & (label != 1), F.col("embedding")).alias("image_vec"),
                    F.when(label > 2, F.reverse("embedding")).alias("text_vec"))
    good, _ = E.mm_concat(rows)
    return M.new_entries(good, at=at()).select("id", "mm_type", "image_url", "image_id", *t.vector_digest())


def responses(spark, sf):
    """Logged hits as responses; the answer's number is the entry id."""
    return t.query_log(spark, sf).select("cache_hit", F.expr("substr(answer, 2)").alias("hit_id"))


@query("apply_hit_counts", f"""WITH {t.ENTRIES}, {t.LOG},
hits AS (SELECT substr(answer, 2) AS id, count(*) AS n FROM query_log WHERE cache_hit GROUP BY ALL)
SELECT e.id, (hit_count + coalesce(n, 0))::BIGINT AS hit_count,
  CASE WHEN n IS NULL THEN gmt_modified ELSE {_SQL_AT} END AS gmt_modified
FROM entries e LEFT JOIN hits h ON e.id = h.id""")
def apply_hit_counts(spark, sf):
    return M.apply_hit_counts(t.entries(spark, sf), responses(spark, sf), at()).select(
        "id", "hit_count", "gmt_modified")


def to_remove(spark, sf):
    """Ids named by users of the event table."""
    return t.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"))


_GONE = "id IN (SELECT user_id::VARCHAR FROM events)"


@query("soft_delete", f"WITH {t.ENTRIES} SELECT id, is_deleted OR {_GONE} AS is_deleted FROM entries")
def soft_delete(spark, sf):
    return M.soft_delete(t.entries(spark, sf), to_remove(spark, sf)).select("id", "is_deleted")


@query("hard_delete", f"WITH {t.ENTRIES} SELECT id, model FROM entries WHERE NOT ({_GONE})")
def hard_delete(spark, sf):
    return M.hard_delete(t.entries(spark, sf), to_remove(spark, sf)).select("id", "model")


@query("truncate_model", f"""WITH {t.ENTRIES}, {t.LOG}
SELECT model, 'entries' AS part, count(*) AS rows FROM entries WHERE model <> 'team_b_2' GROUP BY ALL
UNION ALL SELECT model, 'log', count(*) FROM query_log WHERE model <> 'team_b_2' GROUP BY ALL
UNION ALL SELECT model, 'removed', count(*) FROM entries WHERE model = 'team_b_2' GROUP BY ALL""")
def truncate_model(spark, sf):
    entries, log, gone = M.truncate_model(t.entries(spark, sf), t.query_log(spark, sf), ["team_b_2"])
    count = lambda df, part: df.groupBy("model").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "part", F.lit(part))
    return count(entries, "entries").unionByName(count(log, "log")).unionByName(
        gone.select("model", F.col("delete_count").alias("rows"), F.lit("removed").alias("part")))


@query("purge_deleted", f"""WITH {t.ENTRIES}
SELECT id, model, 0::BIGINT AS purged FROM entries WHERE NOT is_deleted
UNION ALL SELECT NULL, model, count(*) FROM entries WHERE is_deleted GROUP BY model""")
def purge_deleted(spark, sf):
    kept, purged = M.purge_deleted(t.entries(spark, sf))
    return kept.select("id", "model", F.lit(0).cast("long").alias("purged")).unionByName(
        purged.select(F.lit(None).cast("string").alias("id"), "model", "purged"))


@query("compact_entries", f"""WITH {t.ENTRIES} SELECT id, model, question, is_deleted,
  {t.sql_digest()} FROM entries WHERE NOT is_deleted""")
def compact_entries(spark, sf):
    path = shared_dir(spark, "compact")
    M.compact_entries(t.entries(spark, sf).select(*S.ENTRY.names), path)
    return spark.read.schema(S.ENTRY).parquet(path).select(
        "id", "model", "question", "is_deleted", *t.vector_digest())


@query("ids_by_state", f"WITH {t.ENTRIES} SELECT id, is_deleted AS marked FROM entries")
def ids_by_state(spark, sf):
    e = t.entries(spark, sf)
    return M.ids_by_state(e, True).withColumn("marked", F.lit(True)).unionByName(
        M.ids_by_state(e, False).withColumn("marked", F.lit(False)))


_COUNTS = """counts AS (SELECT model, count(*) AS total, count(*) FILTER (WHERE NOT is_deleted) AS live,
  count(*) FILTER (WHERE is_deleted) AS marked FROM entries GROUP BY model)"""


@query("count_by_state", f"WITH {t.ENTRIES}, {_COUNTS} SELECT * FROM counts")
def count_by_state(spark, sf):
    return M.count_by_state(t.entries(spark, sf))


@query("check_evict", f"""WITH {t.ENTRIES}, {_COUNTS}
SELECT model, marked, marked > 5000 OR marked / total > 0.1 AS purge FROM counts""")
def check_evict(spark, sf):
    return M.check_evict(t.entries(spark, sf)).select("model", "marked", "purge")


def _wanted(spark, sf):
    e = t.read(spark, sf, "events")
    return e.select(F.when(F.col("event_type") == "error", "").otherwise(
        t.normalize_model(t.tenant(F.col("user_id")))).alias("model"),
        F.when(F.col("event_type") == "view", "mm").when(F.col("event_type") == "click", "text")
        .alias("mm_type"))


_WANTED = f"""wanted AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN '' ELSE
    {t.sql_norm(t.sql_tenant('user_id'))} END AS model,
  CASE event_type WHEN 'view' THEN 'mm' WHEN 'click' THEN 'text' END AS mm_type FROM events),
known AS (SELECT DISTINCT model, mm_type FROM entries WHERE model <> 'images_test')"""


def _known(spark, sf):
    return (t.entries(spark, sf).where("model <> 'images_test'").select("model", "mm_type").distinct()
            .withColumn("dim", F.lit(64)).withColumn("metric", F.lit("l2")))


@query("register_collections", f"""WITH {t.ENTRIES}, {_WANTED}
SELECT w.model, w.mm_type, (CASE WHEN w.model = '' THEN 502 ELSE 0 END)::INTEGER AS error_code,
  CASE WHEN w.model = '' THEN NULL WHEN k.model IS NOT NULL THEN 'already_exists' ELSE 'create_success' END AS response
FROM wanted w LEFT JOIN known k ON w.model = k.model AND w.mm_type IS NOT DISTINCT FROM k.mm_type""")
def register_collections(spark, sf):
    return M.register_collections(_wanted(spark, sf), _known(spark, sf), 64)[0]


@query("collections_after_register", f"""WITH {t.ENTRIES}, {_WANTED}
SELECT model, mm_type, 64::INTEGER AS dim, 'l2' AS metric FROM known
UNION SELECT model, mm_type, 64, 'l2' FROM wanted WHERE model <> ''""")
def collections_after_register(spark, sf):
    return M.register_collections(_wanted(spark, sf), _known(spark, sf), 64)[1]


@query("remove_status", f"""WITH {t.ENTRIES}, asked AS (SELECT event_id::VARCHAR AS request_id, user_id,
    {t.sql_norm(t.sql_tenant('user_id'))} AS model, props->>'$.k' AS k,
    CASE event_type WHEN 'view' THEN 'truncate_by_model' WHEN 'error' THEN 'drop' ELSE 'delete_by_id' END AS remove_type
  FROM events),
named AS (SELECT DISTINCT request_id, model, unnest([user_id::VARCHAR, k]) AS id FROM asked WHERE remove_type = 'delete_by_id'),
found AS (SELECT n.request_id, count(*) AS n FROM named n JOIN entries e ON n.model = e.model AND n.id = e.id GROUP BY ALL),
sizes AS (SELECT model, count(*) AS n FROM entries GROUP BY model)
SELECT a.request_id, (CASE remove_type WHEN 'drop' THEN 401 ELSE 0 END)::INTEGER AS error_code,
  CASE remove_type WHEN 'drop' THEN 'failed' ELSE 'success' END AS status,
  (CASE remove_type WHEN 'drop' THEN 0 WHEN 'truncate_by_model' THEN coalesce(s.n, 0) ELSE coalesce(f.n, 0) END)::BIGINT AS delete_count
FROM asked a LEFT JOIN found f ON a.request_id = f.request_id LEFT JOIN sizes s ON a.model = s.model""")
def remove_status(spark, sf):
    kind = F.col("event_type")
    asked = t.read(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        t.normalize_model(t.tenant(F.col("user_id"))).alias("model"),
        F.array(F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("id_list"),
        F.when(kind == "view", "truncate_by_model").when(kind == "error", "drop")
        .otherwise("delete_by_id").alias("remove_type"))
    return M.remove_status(asked, t.entries(spark, sf))
