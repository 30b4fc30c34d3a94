"""Ranks, gates, picks and whole lookups."""

from pyspark.sql import functions as F

from answerlake.functions import ranking as R
from answerlake.operators import gate as G
from answerlake.operators import vector_join as vj
from answerlake.operators.lookup import scalar_fetch
from answerlake.plans import cache_lookup as plan
from registry import query
from registry import tables as t
from registry.search import live

GATE = R.Gate(threshold=0.90, threshold_long=0.95)
WIDE = R.Gate(threshold=0.60, threshold_long=0.65)


def _lookup_sql(metric="l2", by=("model",), short=3.8, long=3.8, limit=256, extra=""):
    rank = "4 - least(greatest(n.score, 0), 4)" if metric == "l2" else "n.score"
    cols = "".join(f", coalesce(h.{c}, '') AS {c}" for c in extra.split())
    return f"""WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(1, metric, by)},
hits AS (SELECT n.request_id, e.*, {rank} AS rank FROM near n JOIN entries e ON n.id = e.id
  WHERE {rank} >= {short} AND {rank} >= CASE WHEN length(n.key) <= {limit} THEN {short} ELSE {long} END)
SELECT p.request_id, 0::INTEGER AS error_code, '' AS error_desc, h.id IS NOT NULL AS cache_hit,
  h.id AS hit_id, round(h.rank, 6) AS rank, coalesce(h.question, '') AS hit_query,
  coalesce(h.answer, '') AS answer{cols}
FROM planted p LEFT JOIN hits h ON p.request_id = h.request_id"""


def _rounded(df):
    return df.withColumn("rank", F.round("rank", 6))


@query("cache_lookup_l2", _lookup_sql())
def cache_lookup_l2(spark, sf):
    return _rounded(plan.cache_lookup(t.planted(spark, sf), t.entries(spark, sf)))


@query("cache_lookup_l2_blocked", _lookup_sql(short=3.6, long=3.6))
def cache_lookup_l2_blocked(spark, sf):
    return _rounded(plan.cache_lookup(t.planted(spark, sf), t.entries(spark, sf),
                                      R.Gate(threshold=0.90, threshold_long=0.90), method="tiles"))


@query("cache_lookup_cosine", _lookup_sql("cosine", short=0.9, long=0.9))
def cache_lookup_cosine(spark, sf):
    return _rounded(plan.cache_lookup_cosine(t.planted(spark, sf), t.entries(spark, sf)))


@query("cache_lookup_mm", _lookup_sql(by=("model", "mm_type"), limit=50, extra="image_url image_id"))
def cache_lookup_mm(spark, sf):
    return _rounded(plan.cache_lookup_mm(t.planted(spark, sf), t.entries(spark, sf)))


# --- single steps over five candidates a request ---

_FIVE = f"WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(5)}"
_RANK = "4 - least(greatest(score, 0), 4)"


def five(spark, sf):
    return vj.knn(t.planted(spark, sf), live(spark, sf), k=5)


def gated(spark, sf, gate=WIDE):
    """Candidates after both gates, with request key and entry text."""
    near = G.score_gate(five(spark, sf).select("request_id", "id", "score"), gate)
    keyed = scalar_fetch(near, t.entries(spark, sf)).join(
        t.planted(spark, sf).select("request_id", "key"), "request_id")
    return G.length_gate(keyed, gate)


def _gated_sql(short=2.4, long=2.6, name="gated"):
    return f"""{_FIVE},
ranked AS (SELECT *, {_RANK} AS rank, max({_RANK}) OVER (PARTITION BY request_id) AS best FROM near),
{name} AS (SELECT r.*, e.question, e.answer FROM ranked r JOIN entries e ON r.id = e.id
  WHERE best >= {short} AND rank >= CASE WHEN length(key) <= 256 THEN {short} ELSE {long} END)"""


@query("rank_distance", f"""{_FIVE}
SELECT request_id, id, round({_RANK}, 6) AS rank, round(least(greatest(score, 0), 4), 6) AS positive_rank
FROM near""")
def rank_distance(spark, sf):
    return five(spark, sf).select(
        "request_id", "id", F.round(R.rank_distance(F.col("score")), 6).alias("rank"),
        F.round(R.rank_distance(F.col("score"), positive=True), 6).alias("positive_rank"))


@query("rank_exact", f"""WITH {t.ENTRIES}, {t.PLANTED}
SELECT p.request_id, e.id, (CASE WHEN p.key = e.question THEN 1 ELSE 0 END)::INTEGER AS rank
FROM planted p JOIN entries e ON p.truth = e.id""")
def rank_exact(spark, sf):
    e = t.entries(spark, sf)
    p = t.planted(spark, sf).withColumnRenamed("truth", "id").select("request_id", "id", "key")
    return p.join(e.select("id", "question"), "id").select(
        "request_id", "id", R.rank_exact(F.col("key"), F.col("question")).alias("rank"))


@query("threshold_scale", """SELECT event_id, round(least(greatest(4 * (value / 100), 0), 4), 6) AS cut,
  round(least(greatest(4 * (value / 100) * 0.8, 0), 4), 6) AS cut_long FROM events""")
def threshold_scale(spark, sf):
    e = t.read(spark, sf, "events")
    share = F.col("value") / 100
    return e.select("event_id", F.round(R.scale_threshold(share), 6).alias("cut"),
                    F.round(R.scale_threshold(share, cache_factor=0.8), 6).alias("cut_long"))


@query("gate_l2", _gated_sql() + "\nSELECT request_id, id, round(rank, 6) AS rank FROM gated")
def gate_l2(spark, sf):
    return gated(spark, sf).select("request_id", "id", F.round("rank", 6).alias("rank"))


@query("gate_cosine", f"""WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(5, 'cosine')},
ranked AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS best FROM near)
SELECT request_id, id, round(score, 6) AS rank FROM ranked WHERE best >= 0.9 AND score >= 0.9""")
def gate_cosine(spark, sf):
    near = vj.knn(t.planted(spark, sf), live(spark, sf), k=5, metric="cosine")
    near = near.join(t.planted(spark, sf).select("request_id", "key"), "request_id")
    kept = G.length_gate(G.score_gate(near, R.COSINE), R.COSINE)
    return kept.select("request_id", "id", F.round("rank", 6).alias("rank"))


@query("sort_candidates", _gated_sql() + """
SELECT request_id, id, round(rank, 6) AS rank,
  row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, id)::INTEGER AS place FROM gated""")
def sort_candidates(spark, sf):
    return G.sort_candidates(gated(spark, sf)).select(
        "request_id", "id", F.round("rank", 6).alias("rank"), "place")


@query("pick_first", _gated_sql() + """
SELECT request_id, id, answer FROM gated
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, id) = 1""")
def pick_first(spark, sf):
    return G.pick_first(gated(spark, sf)).select("request_id", "id", "answer")


@query("pick_random", _gated_sql() + """
SELECT request_id, id, answer FROM gated
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY md5('7|' || request_id || '|' || id), id) = 1""")
def pick_random(spark, sf):
    return G.pick_random(gated(spark, sf), 7).select("request_id", "id", "answer")


@query("pick_all", _gated_sql() + """
SELECT request_id, string_agg(id, ',' ORDER BY rank DESC, id) AS ids,
  string_agg(question, ',' ORDER BY rank DESC, id) AS questions,
  string_agg(answer, ',' ORDER BY rank DESC, id) AS answers FROM gated GROUP BY request_id""")
def pick_all(spark, sf):
    return G.pick_all(gated(spark, sf)).select(
        "request_id", *[F.array_join(c, ",").alias(c) for c in ("ids", "questions", "answers")])


_TOK = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r]+'), lambda x: x <> ''))"


@query("rerank", f"""WITH {t.PAIRS},
cand AS (SELECT 'r' || p.conv_id || ':' || p.turn AS request_id, p.question AS key,
    u.conv_id || ':' || u.turn AS id, u.text AS question
  FROM pairs p JOIN conversations u ON u.conv_id = p.conv_id AND u.turn IN (p.turn - 1, p.turn + 1)),
tok AS (SELECT *, {_TOK('key')} AS a, {_TOK('question')} AS b FROM cand),
scored AS (SELECT request_id, id, key, len(list_intersect(a, b)) /
    (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS rank FROM tok)
SELECT request_id, id, round(rank, 6) AS rank FROM scored
WHERE rank >= CASE WHEN length(key) <= 256 THEN 0.04 ELSE 0.2 END""")
def rerank(spark, sf):
    """The messages before and after a question, re-scored by token overlap."""
    gate = R.Gate(threshold=0.01, threshold_long=0.05)
    turns = t.read(spark, sf, "conversations")
    asked = t.pairs(spark, sf).select(
        "conv_id", F.concat(F.lit("r"), F.concat_ws(":", "conv_id", "turn")).alias("request_id"),
        F.col("question").alias("key"), F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1))
        .alias("turn"))
    cand = asked.join(turns.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"),
                                   F.col("text").alias("question")), ["conv_id", "turn"])
    kept = G.rerank(cand, R.token_overlap(F.col("key"), F.col("question")), gate)
    return kept.select("request_id", "id", F.round("rank", 6).alias("rank"))


@query("build_response", f"""WITH {t.LOG}
SELECT log_id::VARCHAR AS request_id, error_code, error_desc,
  cache_hit AND error_code = 0 AS cache_hit,
  CASE WHEN cache_hit AND error_code = 0 THEN answer END AS hit_id,
  CASE WHEN cache_hit AND error_code = 0 THEN round(delta_time, 6) END AS rank,
  CASE WHEN cache_hit AND error_code = 0 THEN hit_query ELSE '' END AS hit_query,
  CASE WHEN cache_hit AND error_code = 0 THEN answer ELSE '' END AS answer
FROM query_log""")
def build_response(spark, sf):
    log = t.query_log(spark, sf).withColumn("request_id", F.col("log_id").cast("string"))
    picked = log.where("cache_hit").select(
        "request_id", F.col("answer").alias("id"), F.col("delta_time").alias("rank"),
        F.col("hit_query").alias("question"), "answer")
    return _rounded(plan.build_response(log, picked))


@query("dependency_question", """WITH asked AS (
  SELECT event_id, 'q' || (props->>'$.k') AS question, 's' || user_id AS stored,
    CASE WHEN event_type IN ('view', 'click') THEN event_type END AS dep,
    CASE WHEN event_type = 'view' THEN 'view' WHEN event_type = 'error' THEN 'error' END AS stored_dep
  FROM events)
SELECT event_id, CASE WHEN dep IS NOT NULL AND stored_dep IS NOT NULL THEN dep ELSE question END AS asked,
  CASE WHEN dep IS NOT NULL AND stored_dep IS NOT NULL THEN stored_dep ELSE stored END AS compared,
  (CASE WHEN dep IS NOT NULL AND stored_dep IS NOT NULL AND dep = stored_dep THEN 1 ELSE 0 END)::INTEGER AS rank
FROM asked""")
def dependency_question(spark, sf):
    e = t.read(spark, sf, "events")
    dep = lambda c: F.array(F.struct(F.lit("part").alias("name"), c.alias("data"),
                                     F.lit(0).alias("dep_type")))
    kind = F.col("event_type")
    e = e.select("event_id", F.concat(F.lit("q"), F.get_json_object("props", "$.k")).alias("question"),
                 F.concat(F.lit("s"), "user_id").alias("stored"),
                 F.when(kind.isin("view", "click"), dep(kind)).alias("deps"),
                 F.when(kind.isin("view", "error"), dep(kind)).alias("stored_deps"))
    asked = R.evaluated_question(F.col("deps"), F.col("stored_deps"), F.col("question"))
    compared = R.evaluated_question(F.col("stored_deps"), F.col("deps"), F.col("stored"))
    return e.select("event_id", asked.alias("asked"), compared.alias("compared"),
                    R.rank_exact(asked, compared).alias("rank"))


_DEP = """deps AS (SELECT vec_id, CASE WHEN vec_id % 5 < 4 THEN (vec_id % 3)::VARCHAR END AS asked,
  CASE WHEN vec_id % 7 < 6 THEN (CASE WHEN vec_id % 11 < 8 THEN vec_id % 3 ELSE 9 END)::VARCHAR END AS stored FROM embeddings)"""


@query("cache_lookup_deps", f"""WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(1)}, {_DEP},
passed AS (SELECT n.request_id, n.id FROM near n JOIN deps a ON a.vec_id::VARCHAR = n.truth JOIN deps b ON b.vec_id::VARCHAR = n.id
  WHERE 4 - least(n.score, 4) >= 3.8 AND CASE WHEN a.asked IS NOT NULL AND b.stored IS NOT NULL THEN a.asked = b.stored ELSE n.key = 'q' || n.id END)
SELECT p.request_id, x.id IS NOT NULL AS cache_hit, coalesce('q' || x.id, '') AS hit_query, coalesce('a' || x.id, '') AS answer
FROM planted p LEFT JOIN passed x ON x.request_id = p.request_id""")
def cache_lookup_deps(spark, sf):
    """An evaluator that compares dependent questions where both sides have any, else the questions."""
    part = lambda use, data: F.when(use, F.array(F.struct(
        F.lit("part").alias("name"), data.cast("string").alias("data"), F.lit(0).alias("dep_type"))))
    i, j = F.col("truth").cast("long"), F.col("id").cast("long")
    asked = t.planted(spark, sf).withColumn("deps", part(i % 5 < 4, i % 3))
    stored = t.entries(spark, sf).withColumn("deps", part(j % 7 < 6, F.when(j % 11 < 8, j % 3).otherwise(9)))
    scorer = F.when(F.col("question") == F.col("key"), 4.0).otherwise(0.0)
    return plan.cache_lookup(asked, stored, scorer=scorer).select("request_id", "cache_hit", "hit_query", "answer")
