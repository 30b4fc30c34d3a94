"""Keys and request rules."""

from pyspark.sql import functions as F

from answerlake.functions import text as X
from answerlake.operators import conversations as C
from answerlake.operators import shaping as S
from registry import query
from registry import tables as t


@query("normalize_model", f"""SELECT DISTINCT {t.sql_tenant('user_id')} AS raw_model,
  {t.sql_norm(t.sql_tenant('user_id'))} AS model FROM events""")
def normalize_model(spark, sf):
    raw = t.tenant(F.col("user_id"))
    return (t.read(spark, sf, "events").select(raw.alias("raw_model")).distinct()
            .withColumn("model", X.normalize_model(F.col("raw_model"))))


_CODES = f"""{t.REQUESTS},
checked AS (SELECT request_id, type, {t.sql_norm('raw_model')} AS model, (CASE
    WHEN raw_model IS NULL AND has_scope THEN 103
    WHEN type IS NULL OR type NOT IN ('query', 'insert', 'remove', 'register') THEN 102
    WHEN raw_model IS NULL THEN 103
    WHEN type = 'remove' AND remove_type = 'drop' THEN 401 ELSE 0 END)::INTEGER AS error_code
  FROM requests),
barred AS (SELECT request_id, type, model, (CASE WHEN error_code <> 0 THEN error_code
    WHEN model = 'DI_COPILOT_LAB' AND type = 'query' THEN 105
    WHEN model = 'DI_COPILOT_LAB' AND type = 'insert' THEN 305 ELSE 0 END)::INTEGER AS error_code
  FROM checked)"""


@query("validate_requests", f"WITH {_CODES} SELECT request_id, type, model, error_code FROM checked")
def validate_requests(spark, sf):
    return S.validate_requests(t.typed_requests(spark, sf)).select(
        "request_id", "type", "model", "error_code")


def checked(spark, sf):
    return S.blacklist_filter(S.validate_requests(t.typed_requests(spark, sf)))


@query("blacklist_filter", f"""WITH {_CODES} SELECT request_id, type, model, error_code,
  CASE WHEN error_code IN (105, 305) THEN 'model: ' || model || ' in blacklist' ELSE '' END AS error_desc
FROM barred""")
def blacklist_filter(spark, sf):
    return checked(spark, sf).select("request_id", "type", "model", "error_code", "error_desc")


@query("route_requests", f"""WITH {_CODES} SELECT request_id, error_code,
  CASE WHEN error_code = 0 THEN type ELSE 'rejected' END AS route FROM barred""")
def route_requests(spark, sf):
    out = None
    for name, frame in S.route_requests(checked(spark, sf)).items():
        rows = frame.select("request_id", "error_code", F.lit(name).alias("route"))
        out = rows if out is None else out.unionByName(rows)
    return out


_LAST = """last AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text
  FROM conversations GROUP BY conv_id)"""


@query("key_last_content", f"WITH {_LAST} SELECT conv_id, text AS key FROM last")
def key_last_content(spark, sf):
    last = C.last_message(t.read(spark, sf, "conversations"))
    return last.select("conv_id", F.col("text").alias("key"))


@query("key_without_prompt", f"""WITH {_LAST}
SELECT conv_id, regexp_replace(text, 'the |[0-9]+|\\.', '', 'g') AS key FROM last""")
def key_without_prompt(spark, sf):
    last = C.last_message(t.read(spark, sf, "conversations"))
    return last.select("conv_id", X.without_prompt(F.col("text"), ["the ", "[0-9]+", r"\."]).alias("key"))


@query("key_all_content", """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS key
FROM conversations GROUP BY conv_id""")
def key_all_content(spark, sf):
    return t.messages(spark, sf).select("conv_id", X.all_content(F.col("query")).alias("key"))


@query("key_with_role", f"WITH {_LAST} SELECT conv_id, role || ': ' || text AS key FROM last")
def key_with_role(spark, sf):
    return t.messages(spark, sf).select("conv_id", X.with_role(F.col("query")).alias("key"))


_SPLICED = """spliced AS (SELECT conv_id, string_agg(role || '###' || text, '|||' ORDER BY turn) AS key
  FROM conversations GROUP BY conv_id)"""


@query("key_multi_splicing", f"WITH {_SPLICED} SELECT * FROM spliced")
def key_multi_splicing(spark, sf):
    return t.messages(spark, sf).select("conv_id", X.multi_splicing(F.col("query")).alias("key"))


@query("split_dialog", f"""WITH {_SPLICED},
odd AS (SELECT conv_id, key || '|||user###a###b###' || conv_id || '|||user###|||no mark' AS key FROM spliced),
parts AS (SELECT conv_id, unnest(string_split(key, '|||')) AS part,
  (generate_subscripts(string_split(key, '|||'), 1) - 1)::INTEGER AS pos FROM odd)
SELECT conv_id, pos, CASE WHEN contains(part, '###') THEN string_split(part, '###')[1] END AS role,
  CASE WHEN NOT contains(part, '###') THEN 'exception'
    ELSE nullif(substr(part, instr(part, '###') + 3), '') END AS content FROM parts""")
def split_dialog(spark, sf):
    """The spliced keys, each with parts that hold marks, no text, and no mark."""
    spliced = t.messages(spark, sf).select("conv_id", F.concat(
        X.multi_splicing(F.col("query")), F.lit("|||user###a###b###"), F.col("conv_id"),
        F.lit("|||user###|||no mark")).alias("key"))
    return (spliced.select("conv_id", F.posexplode(X.dialog_parts(F.col("key"))).alias("pos", "p"))
            .select("conv_id", "pos", "p.role", "p.content"))


@query("key_prompt", """SELECT event_id, props->>'$.k' AS key FROM events""")
def key_prompt(spark, sf):
    """Completion-style request bodies carry one prompt field."""
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("prompt")))
    return t.read(spark, sf, "events").select(
        "event_id", F.from_json(body, "prompt string")["prompt"].alias("key"))


def mm_requests(spark, sf):
    b = t.read(spark, sf, "benchmark")
    i, half = F.col("item_id"), F.expr("cast(char_length(text) div 2 as int)")
    return b.select(
        "item_id", X.normalize_model(t.tenant(i)).alias("model"),
        F.when(i % 5 != 4, F.array(F.expr("substring(text, 1, char_length(text) div 2)"),
                                   F.substring("text", half + 1, F.char_length("text"))))
        .otherwise(F.array(F.lit(""))).alias("text"),
        F.when((i % 4).isin(0, 2), F.concat(F.lit("http://img/"), i)).otherwise("").alias("imageUrl"),
        F.when((i % 4).isin(1, 2), F.concat(F.lit("raw"), i)).alias("imageRaw"),
        F.element_at(F.array(F.lit("IMG_TEXT"), F.lit("TEXT"), F.lit("OTHER")),
                     (i % 3 + 1).cast("int")).alias("multiType"))


MM = f"""mm_requests AS (
  SELECT item_id, {t.sql_norm(t.sql_tenant('item_id'))} AS model,
    CASE WHEN item_id % 5 <> 4 THEN substr(text, 1, length(text) // 2) || '###' ||
      substr(text, length(text) // 2 + 1) ELSE '' END AS key,
    item_id % 4 IN (0, 2) AS url, item_id % 4 IN (1, 2) AS raw,
    CASE item_id % 3 WHEN 0 THEN 'IMG_TEXT' WHEN 1 THEN 'TEXT' ELSE 'OTHER' END AS kind
  FROM benchmark)"""


@query("mm_key", f"""WITH {MM}, checked AS (SELECT *,
  CASE WHEN kind = 'IMG_TEXT' AND url AND raw THEN 'both image forms given'
    WHEN kind = 'IMG_TEXT' AND NOT url AND NOT raw THEN 'no image given'
    WHEN kind = 'OTHER' THEN 'unknown multiType' ELSE '' END AS error_desc FROM mm_requests)
SELECT item_id, key, error_desc, CASE WHEN error_desc = '' AND kind = 'IMG_TEXT' THEN
  CASE WHEN url THEN 'http://img/' || item_id ELSE 'raw' || item_id END END AS image FROM checked""")
def mm_key(spark, sf):
    return S.mm_key(mm_requests(spark, sf)).select("item_id", "key", "error_desc", "image")


@query("mm_key_insert", f"""WITH {MM}, checked AS (SELECT *,
  CASE WHEN url AND raw THEN 'both image forms given'
    WHEN NOT url AND NOT raw AND key = '' THEN 'no image given' ELSE '' END AS error_desc FROM mm_requests)
SELECT item_id, key, error_desc, CASE WHEN error_desc = '' THEN
  CASE WHEN url THEN 'http://img/' || item_id WHEN raw THEN 'raw' || item_id END END AS image FROM checked""")
def mm_key_insert(spark, sf):
    return S.mm_key(mm_requests(spark, sf), insert=True).select("item_id", "key", "error_desc", "image")


@query("mm_type_map", f"""WITH {MM} SELECT item_id, CASE kind WHEN 'IMG_TEXT' THEN 'mm' WHEN 'TEXT' THEN 'text' END AS mm_type,
  CASE kind WHEN 'IMG_TEXT' THEN 'multi_cache_' || model || '_mm'
    WHEN 'TEXT' THEN 'multi_cache_' || model || '_text' END AS collection FROM mm_requests""")
def mm_type_map(spark, sf):
    known, rejects = S.with_collection(mm_requests(spark, sf))
    return known.unionByName(rejects).select("item_id", "mm_type", "collection")


@query("length_class", """SELECT conv_id, turn,
  CASE WHEN length(text) <= 256 THEN 'short' ELSE 'long' END AS text_class,
  CASE WHEN length(text) <= 50 THEN 'short' ELSE 'long' END AS mm_class FROM conversations""")
def length_class(spark, sf):
    text = F.col("text")
    return t.read(spark, sf, "conversations").select(
        "conv_id", "turn", X.length_class(text).alias("text_class"),
        X.length_class(text, 50).alias("mm_class"))


@query("cache_enable", "SELECT conv_id, turn, text FROM conversations WHERE role <> 'system'")
def cache_enable(spark, sf):
    return S.cache_enabled(t.read(spark, sf, "conversations").select("conv_id", "turn", "text", "role"),
                           F.col("role") != "system").drop("role")
