"""Embedding jobs."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from answerlake.functions import vectors as V
from answerlake.functions.text import tokens
from answerlake.operators import embed as E
from answerlake.runtime import cut_lineage
from registry import query
from registry import tables as t

DIM = 8


def hash_model():
    """Stand-in for a model: eight numbers from a text's md5."""
    def embed(texts):
        raw = b"".join(hashlib.md5(x.encode()).digest() for x in texts)
        return np.frombuffer(raw, dtype=">u2").reshape(-1, DIM) / 65535.0 * 2 - 1
    return embed


def unit(text):
    """Vector of a token, from md5 of the token and each dimension."""
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: F.conv(F.substring(F.md5(
        F.concat(text, F.lit(":"), d)), 1, 4), 16, 10).cast("double") / 65535.0 * 2 - 1)


_TOKEN_TABLES = {}


def token_vectors(docs, name=None):
    """The token table of a corpus. A named one is built once a session and
    reused, as the stored table of an embedding model would be."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if name is None or key not in _TOKEN_TABLES:
        words = docs.select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
        table = cut_lineage(words.withColumn("vec", unit(F.col("token"))), "token-vectors")
        if name is None:
            return table
        _TOKEN_TABLES[key] = table
    return _TOKEN_TABLES[key]


def sql_tokens(source, key):
    return f"""words AS (SELECT {key}, u.t AS token, u.i AS pos FROM (
    SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w
    FROM {source}), LATERAL (SELECT unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i) u),
dims AS (SELECT token, d::INTEGER AS pos, ('0x' || substr(md5(token || ':' || d), 1, 4))::INTEGER / 65535.0::DOUBLE * 2 - 1 AS x
  FROM (SELECT DISTINCT token FROM words), range(0, {DIM}) r(d))"""


def _rows(df, key):
    return df.select(key, F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("embed_with", f"""SELECT doc_id, d::INTEGER AS pos,
  round((('0x' || substr(md5(text), 1 + 4 * d::INTEGER, 4))::INTEGER / 65535.0::DOUBLE * 2 - 1)::FLOAT::DOUBLE, 6) AS x
FROM documents, range(0, {DIM}) r(d)""")
def embed_with(spark, sf):
    docs = t.read(spark, sf, "documents").select("doc_id", "text")
    out = E.embed_with(docs, "text", hash_model, DIM).select(
        "doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return _rows(out, "doc_id")


@query("embed_token_mean", f"""WITH {sql_tokens('documents', 'doc_id')}
SELECT w.doc_id, d.pos, round(avg(d.x), 6) AS x FROM words w JOIN dims d USING (token) GROUP BY ALL"""
       .replace("w JOIN dims d USING (token)", "w JOIN dims d ON w.token = d.token"))
def embed_token_mean(spark, sf):
    docs = t.read(spark, sf, "documents")
    return _rows(E.embed_token_mean(docs, "doc_id", "text", token_vectors(docs, f"{sf}/documents"), DIM), "doc_id")


@query("embed_masked_mean", f"""WITH {sql_tokens('conversations', 'conv_id')},
masked AS (SELECT conv_id, token, CASE WHEN length(token) > 3 THEN 1 ELSE 0 END AS m FROM words)
SELECT conv_id, d.pos, round(sum(d.x * m) / greatest(sum(m), 1e-9::DOUBLE), 6) AS x
FROM masked w JOIN dims d ON w.token = d.token GROUP BY ALL""")
def embed_masked_mean(spark, sf):
    docs = t.read(spark, sf, "conversations")
    word = docs.select("conv_id", F.explode(tokens(F.col("text"))).alias("token"))
    rows = word.select("conv_id", unit(F.col("token")).alias("vec"),
                       F.when(F.char_length("token") > 3, 1).otherwise(0).alias("mask"))
    return _rows(E.embed_masked_mean(rows, "conv_id", DIM), "conv_id")


@query("embed_long_windowed", f"""WITH {sql_tokens('documents', 'doc_id')},
windows AS (SELECT w.doc_id, w.pos // 510 AS win, d.pos, avg(d.x) AS x
  FROM words w JOIN dims d ON w.token = d.token GROUP BY ALL)
SELECT doc_id, pos, round(avg(x), 6) AS x FROM windows GROUP BY ALL""")
def embed_long_windowed(spark, sf):
    docs = t.read(spark, sf, "documents")
    return _rows(E.embed_long_windowed(docs, "doc_id", "text", token_vectors(docs, f"{sf}/documents"), DIM), "doc_id")


@query("embed_identity", "SELECT conv_id, turn, text AS embedding FROM conversations")
def embed_identity(spark, sf):
    return E.embed_identity(t.read(spark, sf, "conversations"), "text").select(
        "conv_id", "turn", "embedding")


@query("mm_concat", """WITH parts AS (SELECT vec_id, label < 7 AND label <> 1 AS i, label > 2 AS t, embedding AS e
  FROM embeddings), joined AS (SELECT vec_id, CASE WHEN i AND t THEN 'mm' WHEN i THEN 'image' WHEN t THEN 'text' END AS mm_type,
  CASE WHEN i AND t THEN list_concat(e, list_reverse(e)) WHEN i THEN e WHEN t THEN list_reverse(e) ELSE [NULL] END AS v FROM parts)
SELECT vec_id, mm_type, unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INTEGER AS pos FROM joined""")
def mm_concat(spark, sf):
    label = F.col("label")
    e = t.read(spark, sf, "embeddings").select(
        "vec_id", F.when((label < 7) & (label != 1), F.col("embedding")).alias("image_vec"),
        F.when(label > 2, F.reverse("embedding")).alias("text_vec"))
    good, rejects = E.mm_concat(e)
    rows = good.select("vec_id", "mm_type", F.posexplode("embedding").alias("pos", "x"))
    return rows.unionByName(rejects.select("vec_id", "mm_type", F.lit(0).alias("pos"),
                                           F.lit(None).cast("float").alias("x")))


@query("pool_features", """SELECT vec_id, (c - 1)::INTEGER AS pos, 'tokens' AS kind,
  round(embedding[c::INTEGER]::DOUBLE, 6) AS x FROM embeddings, range(1, 17) r(c)
UNION ALL SELECT vec_id, c::INTEGER AS pos, 'maps' AS kind,
  round(list_sum(embedding[(c * 16 + 1)::INTEGER:(c * 16 + 16)::INTEGER]::DOUBLE[]) / 16, 6) AS x
FROM embeddings, range(0, 4) r(c)""")
def pool_features(spark, sf):
    """Vectors read as 4 tokens x 16 channels, and as 4 maps of 4 x 4 cells."""
    e = t.read(spark, sf, "embeddings")
    cut = lambda of, n, size: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(of, i * size + 1, F.lit(size)))
    tokens_ = cut(F.col("embedding"), 4, 16)
    maps = F.transform(cut(F.col("embedding"), 4, 16), lambda m: cut(m, 4, 4))
    part = lambda pooled, kind: e.select(
        "vec_id", F.lit(kind).alias("kind"), F.posexplode(pooled).alias("pos", "x"))
    return part(E.pool_tokens(tokens_), "tokens").unionByName(
        part(E.pool_spatial(maps), "maps")).withColumn("x", F.round("x", 6))


@query("l2_normalize", """WITH scaled AS (SELECT vec_id, label,
  list_transform(embedding::DOUBLE[], lambda x: x * label) AS v FROM embeddings)
SELECT vec_id, unnest(CASE WHEN label = 0 THEN [NULL]
    ELSE list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) END) AS x,
  (generate_subscripts(CASE WHEN label = 0 THEN [NULL] ELSE v END, 1) - 1)::INTEGER AS pos FROM scaled""")
def l2_normalize(spark, sf):
    """Vectors scaled by their label; label 0 gives a zero vector, hence null."""
    e = t.read(spark, sf, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("label"))
    unit_ = e.select("vec_id", V.l2_normalize(scaled).alias("v"))
    return unit_.select("vec_id", F.posexplode_outer("v").alias("pos", "x")).select(
        "vec_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.round("x", 6).alias("x"))


@query("check_dimension", f"""WITH {t.ENTRIES}
SELECT id, model = 'images_test' OR label = 5 OR model = 'DI_COPILOT_LAB' AS rejected FROM entries""")
def check_dimension(spark, sf):
    """Label 5 vectors lack their last number; one tenant expects 32 numbers, one
    has no collection."""
    e = t.entries(spark, sf)
    short = e.withColumn("embedding", F.when(F.col("label") == 5, F.slice("embedding", 1, 63))
                         .otherwise(F.col("embedding")))
    collections = (e.where("model <> 'DI_COPILOT_LAB'").groupBy("model").agg(F.lit(1))
                   .select("model", F.when(F.col("model") == "images_test", 32).otherwise(64).alias("dim")))
    good, bad = E.check_dimension(short, collections)
    return good.select("id", F.lit(False).alias("rejected")).unionByName(
        bad.select("id", F.lit(True).alias("rejected")))
