"""Log reports."""

from pyspark.sql import functions as F

from answerlake.functions.text import length_class
from answerlake.operators import analytics as A
from answerlake.operators import maintain as M
from answerlake.operators import vector_join as vj
from registry import query
from registry import tables as t
from registry.maintenance import responses
from registry.search import live


def _round(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("report_totals", f"""WITH {t.OP_TIMES}, {t.LOG},
times AS (SELECT model, count(*) FILTER (WHERE op = 'embedding') AS embedding_count,
    coalesce(sum(seconds) FILTER (WHERE op = 'embedding'), 0) AS embedding_time,
    count(*) FILTER (WHERE op = 'search') AS search_count,
    coalesce(sum(seconds) FILTER (WHERE op = 'search'), 0) AS search_time FROM op_times GROUP BY model),
hits AS (SELECT model, count(*) FILTER (WHERE cache_hit) AS hits FROM query_log GROUP BY model)
SELECT t.model, embedding_count, round(embedding_time, 6) AS embedding_time, search_count,
  round(search_time, 6) AS search_time, hits,
  round(embedding_time / embedding_count, 4) AS average_embedding_time,
  round(search_time / search_count, 4) AS average_search_time
FROM times t JOIN hits h ON t.model = h.model""")
def report_totals(spark, sf):
    return _round(A.report_totals(t.op_times(spark, sf), t.query_log(spark, sf)),
                  "embedding_time", "search_time")


@query("hit_rate_by_model", f"""WITH {t.LOG} SELECT model, count(*) AS queries,
  count(*) FILTER (WHERE cache_hit) AS hits, round(avg(cache_hit::INTEGER), 6) AS hit_rate FROM query_log GROUP BY model""")
def hit_rate_by_model(spark, sf):
    return _round(A.hit_rate_by_model(t.query_log(spark, sf)), "hit_rate")


@query("error_breakdown", f"WITH {t.LOG} SELECT model, error_code, count(*) AS rows FROM query_log GROUP BY ALL")
def error_breakdown(spark, sf):
    return A.error_breakdown(t.query_log(spark, sf))


@query("latency_by_hit", f"""WITH {t.LOG} SELECT cache_hit, count(*) AS rows, round(avg(delta_time), 6) AS mean,
  round(quantile_cont(delta_time, 0.5), 6) AS p50, round(quantile_cont(delta_time, 0.95), 6) AS p95
FROM query_log GROUP BY cache_hit""")
def latency_by_hit(spark, sf):
    return _round(A.latency_by_hit(t.query_log(spark, sf)), "mean", "p50", "p95")


@query("latency_by_hit_approx")
def latency_by_hit_approx(spark, sf):
    return A.latency_by_hit(t.query_log(spark, sf), exact=False)


@query("service_speedup", f"""WITH {t.LOG}
SELECT model, count(*) AS requests, round(sum(delta_time + user_id / 100) / sum(delta_time), 6) AS speedup,
  round(avg((answer = 'a' || (user_id % 100))::INTEGER), 6) AS agreement FROM query_log GROUP BY model""")
def service_speedup(spark, sf):
    """Each logged request beside its uncached run, slower by a time per user."""
    log = t.query_log(spark, sf).withColumnRenamed("log_id", "request_id")
    direct = log.select("request_id", (F.col("delta_time") + F.col("user_id") / 100).alias("delta_time"),
                        F.concat(F.lit("a"), F.col("user_id") % 100).alias("answer"))
    return _round(A.service_speedup(log, direct), "speedup", "agreement")


_HITS = f"""{t.ENTRIES}, {t.LOG},
counted AS (SELECT e.id, e.model, count(l.log_id) AS hit_count FROM entries e
  LEFT JOIN query_log l ON l.cache_hit AND substr(l.answer, 2) = e.id GROUP BY ALL)"""


@query("top_hit_entries", f"""WITH {_HITS}
SELECT model, id, hit_count, dense_rank() OVER (PARTITION BY model ORDER BY hit_count DESC)::INTEGER AS place
FROM counted QUALIFY place <= 5""")
def top_hit_entries(spark, sf):
    counted = M.apply_hit_counts(t.entries(spark, sf), responses(spark, sf))
    return A.top_hit_entries(counted, 5)


@query("cold_entries", f"WITH {_HITS} SELECT id, model FROM counted WHERE hit_count = 0")
def cold_entries(spark, sf):
    return A.cold_entries(t.entries(spark, sf), responses(spark, sf)).select("id", "model")


@query("hit_query_recall", f"""WITH {t.ENTRIES}, {t.LOG}
SELECT l.log_id, l.query, e.id, e.question, e.answer FROM query_log l JOIN entries e ON substr(l.answer, 2) = e.id
WHERE l.cache_hit""")
def hit_query_recall(spark, sf):
    log = t.query_log(spark, sf).withColumn("hit_id", F.expr("substr(answer, 2)"))
    return A.hit_query_recall(log, t.entries(spark, sf))


@query("hit_rate_over_time", f"""WITH {t.LOG},
hourly AS (SELECT model, date_trunc('hour', ts) AS hour, count(*) AS queries, count(*) FILTER (WHERE cache_hit) AS hits
  FROM query_log GROUP BY ALL)
SELECT model, hour, queries, hits, round(hits / queries, 6) AS hit_rate,
  round(sum(hits) OVER w / sum(queries) OVER w, 6) AS moving_rate
FROM hourly WINDOW w AS (PARTITION BY model ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def hit_rate_over_time(spark, sf):
    return _round(A.hit_rate_over_time(t.query_log(spark, sf)), "hit_rate", "moving_rate")


@query("log_cube", f"""WITH {t.LOG} SELECT model, cache_hit, error_code, count(*) AS rows,
  grouping_id(model, cache_hit, error_code)::BIGINT AS level FROM query_log GROUP BY CUBE (model, cache_hit, error_code)""")
def log_cube(spark, sf):
    return A.log_cube(t.query_log(spark, sf))


@query("threshold_sweep", f"""WITH {t.ENTRIES}, {t.PLANTED}, {t.knn_sql(1)},
asked AS (SELECT 4 - score AS rank, id, truth, CASE WHEN length(key) <= 256 THEN 'short' ELSE 'long' END AS text_class,
  unnest([3.2, 3.4, 3.6, 3.8, 3.9]::DOUBLE[]) AS threshold FROM near)
SELECT threshold, text_class, count(*) AS requests, count(*) FILTER (WHERE rank >= threshold) AS hits,
  count(*) FILTER (WHERE rank >= threshold AND id = truth) AS right_hits,
  round(count(*) FILTER (WHERE rank >= threshold AND id = truth) / nullif(count(*) FILTER (WHERE rank >= threshold), 0), 6) AS precision
FROM asked GROUP BY ALL""")
def threshold_sweep(spark, sf):
    asked = t.planted(spark, sf)
    near = vj.knn(asked, live(spark, sf), 1).select("request_id", "id", (4 - F.col("score")).alias("rank"))
    nearest = near.join(asked.select("request_id", "truth", length_class(F.col("key")).alias("text_class")),
                        "request_id")
    return _round(A.threshold_sweep(nearest, [3.2, 3.4, 3.6, 3.8, 3.9]), "precision")


@query("distinct_queries", f"WITH {t.LOG} SELECT model, count(DISTINCT query) AS queries FROM query_log GROUP BY model")
def distinct_queries(spark, sf):
    return A.distinct_queries(t.query_log(spark, sf), exact=True)


@query("approx_distinct_queries")
def approx_distinct_queries(spark, sf):
    return A.distinct_queries(t.query_log(spark, sf))


@query("approx_distinct_within", f"WITH {t.LOG} SELECT model, count(DISTINCT query) AS queries, true AS within FROM query_log GROUP BY model")
def approx_distinct_within(spark, sf):
    """Whether the estimate is within five times its stated relative error of 0.02."""
    log = t.query_log(spark, sf)
    near = A.distinct_queries(log).withColumnRenamed("queries", "estimate")
    return A.distinct_queries(log, exact=True).join(near, "model").select(
        "model", "queries", (F.abs(F.col("estimate") - F.col("queries")) <= 0.1 * F.col("queries")).alias("within"))


@query("latency_approx_within", f"""WITH {t.LOG} SELECT cache_hit, count(*) AS rows, true AS p50_within, true AS p95_within
FROM query_log GROUP BY cache_hit""")
def latency_approx_within(spark, sf):
    """Whether the ranks of the approximate percentiles are within 1/10 000 of the rows (and one row)."""
    log = t.query_log(spark, sf)
    near = A.latency_by_hit(log, exact=False).select("cache_hit", "p50", "p95")
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    slack = 1 / 10_000 + 1 / F.count(F.lit(1))
    within = lambda c, p: ((share(F.col("delta_time") <= F.col(c)) >= p - slack)
                           & (share(F.col("delta_time") < F.col(c)) <= p + slack)).alias(f"{c}_within")
    return log.join(F.broadcast(near), "cache_hit").groupBy("cache_hit").agg(
        F.count(F.lit(1)).alias("rows"), within("p50", 0.5), within("p95", 0.95))
