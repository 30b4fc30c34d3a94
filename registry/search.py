"""Exact lookups and vector searches."""

from pyspark.sql import functions as F

from answerlake.operators import approx, lookup, vector_join as vj
from answerlake.operators.range_join import range_join, semantic_dups
from registry import query
from registry import tables as t


def score():
    return F.round("score", 6).alias("score")


def live(spark, sf):
    return t.entries(spark, sf).where(~F.col("is_deleted"))


def _knn_sql(k, metric="l2", by=("model",)):
    return f"""WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(k, metric, by)}
SELECT model, request_id, id, position, round(score, 6) AS score FROM near"""


def _knn(df):
    return df.select("model", "request_id", "id", "position", score())


@query("knn_l2", _knn_sql(5))
def knn_l2(spark, sf):
    return _knn(vj.knn(t.planted(spark, sf), live(spark, sf), k=5))


@query("knn_l2_nearest", _knn_sql(1))
def knn_l2_nearest(spark, sf):
    return _knn(vj.knn(t.planted(spark, sf), live(spark, sf), k=1))


@query("knn_cosine", _knn_sql(5, "cosine"))
def knn_cosine(spark, sf):
    return _knn(vj.knn(t.planted(spark, sf), live(spark, sf), k=5, metric="cosine"))


@query("knn_blocked", _knn_sql(3))
def knn_blocked(spark, sf):
    return _knn(vj.knn(t.planted(spark, sf), live(spark, sf), k=3, method="tiles", tile_rows=64))


@query("knn_mm", _knn_sql(2, by=("model", "mm_type")).replace("SELECT model,", "SELECT model, mm_type,"))
def knn_mm(spark, sf):
    near = vj.knn(t.planted(spark, sf), live(spark, sf), k=2, by=("model", "mm_type"))
    return near.select("model", "mm_type", "request_id", "id", "position", score())


@query("knn_two", f"""WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(2)}
SELECT model, request_id, string_agg(id, ',' ORDER BY position) AS ids,
  round(min(score), 6) AS nearest, round(max(score), 6) AS farthest, count(*) AS found
FROM near GROUP BY ALL""")
def knn_two(spark, sf):
    two = vj.two_nearest(t.planted(spark, sf), live(spark, sf))
    return two.select("model", "request_id", F.array_join("found.id", ",").alias("ids"),
                      F.round(F.col("found")[0]["score"], 6).alias("nearest"),
                      F.round(F.element_at("found", -1)["score"], 6).alias("farthest"),
                      F.size("found").cast("long").alias("found"))


# --- exact keys ---

_USER_PAIRS = t.PAIRS


@query("latest_per_key", f"""WITH {t.sql_access()}
SELECT model, key, max(seq) AS seq, arg_max(op, seq) AS op FROM access_log GROUP BY ALL""")
def latest_per_key(spark, sf):
    return lookup.latest_per_key(t.access_log(spark, sf), ["model", "key"], "seq")


def text_entries(spark, sf):
    """Entries whose question is a user message; one per (question, answer)."""
    p = t.pairs(spark, sf)
    return p.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("team_a_1").alias("model"),
                    F.col("key").alias("question"), "answer", F.lit(False).alias("is_deleted"))


def text_requests(spark, sf):
    c = t.read(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"),
                    F.lit("team_a_1").alias("model"),
                    F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("key"))


_TEXT = f"""{t.PAIRS},
text_entries AS (SELECT conv_id || ':' || turn AS id, 'team_a_1' AS model, key AS question, answer FROM pairs),
text_requests AS (SELECT conv_id || ':' || turn AS request_id, 'team_a_1' AS model, role || ': ' || text AS key
  FROM conversations WHERE role = 'user')"""


@query("exact_lookup", f"""WITH {_TEXT},
stored AS (SELECT model, question, min(id) AS id, arg_min(answer, id) AS answer
  FROM text_entries GROUP BY ALL)
SELECT r.request_id, r.model, r.key, s.id AS hit_id, s.answer
FROM text_requests r LEFT JOIN stored s ON r.model = s.model AND r.key = s.question""")
def exact_lookup(spark, sf):
    return (lookup.exact_lookup(text_requests(spark, sf), text_entries(spark, sf))
            .select("request_id", "model", "key", "hit_id", "answer"))


@query("scalar_fetch", f"""WITH {t.ENTRIES}, {t.LOG}
SELECT l.log_id::VARCHAR AS request_id, e.id, e.question, e.answer
FROM query_log l JOIN entries e ON substr(l.query, 2) = e.id WHERE NOT e.is_deleted""")
def scalar_fetch(spark, sf):
    asked = t.query_log(spark, sf).select(F.col("log_id").cast("string").alias("request_id"),
                                          F.expr("substr(query, 2)").alias("id"))
    return (lookup.scalar_fetch(asked, t.entries(spark, sf))
            .select("request_id", "id", "question", "answer"))


@query("existing_ids", f"""WITH {t.ENTRIES}
SELECT DISTINCT user_id::VARCHAR AS id FROM events WHERE user_id::VARCHAR IN (SELECT id FROM entries)""")
def existing_ids(spark, sf):
    ids = t.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"))
    return lookup.existing_ids(ids, t.entries(spark, sf))


@query("two_tier_lookup", f"""WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(1)},
first_tier AS (SELECT p.request_id, e.id AS hit_id, e.answer, 'first' AS tier
  FROM planted p JOIN entries e ON p.model = e.model AND p.key = e.question WHERE NOT e.is_deleted),
second_tier AS (SELECT n.request_id, n.id AS hit_id, e.answer, 'second' AS tier
  FROM near n JOIN entries e ON n.id = e.id
  WHERE 4 - n.score >= 3.8 AND n.request_id NOT IN (SELECT request_id FROM first_tier))
SELECT * FROM first_tier UNION ALL SELECT * FROM second_tier""")
def two_tier_lookup(spark, sf):
    from answerlake.plans.cache_lookup import cache_lookup
    stored = t.entries(spark, sf)

    def by_vector(misses):
        return cache_lookup(misses, stored).where("cache_hit")

    return lookup.two_tier_lookup(t.planted(spark, sf), stored.where(~F.col("is_deleted")), by_vector)


# --- thresholds and approximate search ---

_RANGE = f"""WITH {t.ENTRIES}, {t.PLANTED}
SELECT p.model, p.request_id, e.id, 1::BIGINT AS copies,
  round(pow(list_distance(p.embedding, e.embedding::DOUBLE[]), 2), 6) AS score
FROM planted p JOIN entries e ON p.model = e.model
WHERE NOT e.is_deleted AND pow(list_distance(p.embedding, e.embedding::DOUBLE[]), 2) <= {{r}}"""


@query("range_join_exact", _RANGE.format(r=0.1))
def range_join_exact(spark, sf):
    return (range_join(t.planted(spark, sf), live(spark, sf), radius=0.1)
            .select("model", "request_id", "id", "copies", score()))


@query("range_join_wide", _RANGE.format(r=1.3))
def range_join_wide(spark, sf):
    return (range_join(t.planted(spark, sf), live(spark, sf), radius=1.3)
            .select("model", "request_id", "id", "copies", score()))


@query("semantic_dups", f"""WITH {t.ENTRIES},
near AS (SELECT b.model, b.id, a.id AS duplicate_of
  FROM entries a JOIN entries b ON a.model = b.model AND a.id < b.id
  WHERE NOT a.is_deleted AND NOT b.is_deleted
    AND pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2) <= 1.3)
SELECT model, id, min(duplicate_of) AS duplicate_of FROM near GROUP BY ALL""")
def semantic_duplicates(spark, sf):
    return semantic_dups(live(spark, sf), radius=1.3).select("model", "id", "duplicate_of")


@query("knn_ivf")
def knn_ivf(spark, sf):
    return _knn(approx.knn_ivf(t.planted(spark, sf), live(spark, sf), k=1, cells=16, probes=10))


@query("knn_lsh")
def knn_lsh(spark, sf):
    return _knn(approx.knn_lsh(t.planted(spark, sf), live(spark, sf), k=1))


@query("knn_ivf_all_cells", _knn_sql(1))
def knn_ivf_all_cells(spark, sf):
    """With every cell probed the search is exact."""
    return _knn(approx.knn_ivf(t.planted(spark, sf), live(spark, sf), k=1, cells=16, probes=16))


@query("knn_ivf_recall", f"WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(1)} SELECT count(*) AS requests, true AS recall_reached FROM near")
def knn_ivf_recall(spark, sf):
    """Whether 10 of 16 cells give at least 0.9 of the exact nearest entries."""
    exact = vj.knn(t.planted(spark, sf), live(spark, sf), k=1).select("request_id", "id")
    near = approx.knn_ivf(t.planted(spark, sf), live(spark, sf), k=1, cells=16, probes=10).select(
        "request_id", F.col("id").alias("found"))
    return exact.join(near, "request_id", "left").agg(
        F.count(F.lit(1)).alias("requests"), (F.avg(F.coalesce(F.col("id") == F.col("found"), F.lit(False)).cast("int")) >= 0.9).alias("recall_reached"))
