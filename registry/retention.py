"""Retention by recency, frequency and segments."""

from pyspark.sql import functions as F

from answerlake.operators import retain as R
from registry import query
from registry import tables as t

N = 200


def _top_sql(keys, order):
    return f"""WITH {t.sql_access()}, keys AS ({keys})
SELECT model, key, row_number() OVER (PARTITION BY model ORDER BY {order})::INTEGER AS position
FROM keys QUALIFY position <= {N}"""


@query("retain_lru", _top_sql("SELECT model, key, max(seq) AS last FROM access_log GROUP BY ALL", "last DESC"))
def retain_lru(spark, sf):
    return R.retain_lru(t.access_log(spark, sf), N)


@query("retain_fifo", _top_sql("SELECT model, key, max(seq) AS last FROM access_log WHERE op = 'put' GROUP BY ALL", "last DESC"))
def retain_fifo(spark, sf):
    return R.retain_fifo(t.access_log(spark, sf), N)


@query("retain_lfu", _top_sql("SELECT model, key, count(*) AS n, max(seq) AS last FROM access_log GROUP BY ALL", "n DESC, last DESC"))
def retain_lfu(spark, sf):
    return R.retain_lfu(t.access_log(spark, sf), N)


@query("retain_random", _top_sql("SELECT DISTINCT model, key FROM access_log", "md5('3|' || model || '|' || key), key"))
def retain_random(spark, sf):
    return R.retain_random(t.access_log(spark, sf), N, 3)


def _freq(every):
    return f"""puts AS (SELECT model, key, (row_number() OVER (PARTITION BY model ORDER BY seq) - 1) // {every} AS block
  FROM access_log WHERE op = 'put'),
ends AS (SELECT model, count(*) // {every} AS done FROM puts GROUP BY model),
frequency AS (SELECT p.model, p.key, (sum((1::HUGEINT << p.block::INTEGER)) // (1::HUGEINT << any_value(e.done)::INTEGER))::BIGINT AS frequency
  FROM puts p JOIN ends e ON p.model = e.model GROUP BY p.model, p.key)"""


@query("decayed_frequency", f"WITH {t.sql_access(False)}, {_freq(20)} SELECT * FROM frequency")
def decayed_frequency(spark, sf):
    return R.decayed_frequency(t.access_log(spark, sf, wide=False), every=20)


@query("decayed_frequency_default", f"WITH {t.sql_access()}, {_freq(10000)} SELECT * FROM frequency")
def decayed_frequency_default(spark, sf):
    return R.decayed_frequency(t.access_log(spark, sf))


_SKETCH = """cells AS (SELECT model, key, d::INTEGER AS depth, (('0x' || substr(md5(d || ':' || key), 1, 8))::BIGINT % 1024)::INTEGER AS bucket
  FROM access_log, range(0, 4) r(d) WHERE op = 'put'),
sketch AS (SELECT model, depth, bucket, count(*) AS count FROM cells GROUP BY ALL)"""


@query("freq_sketch", f"WITH {t.sql_access()}, {_SKETCH} SELECT * FROM sketch")
def freq_sketch(spark, sf):
    return R.freq_sketch(t.access_log(spark, sf))


@query("sketch_estimates", f"""WITH {t.sql_access()}, {_SKETCH},
asked AS (SELECT DISTINCT model, key, d::INTEGER AS depth, (('0x' || substr(md5(d || ':' || key), 1, 8))::BIGINT % 1024)::INTEGER AS bucket
  FROM access_log, range(0, 4) r(d))
SELECT a.model, a.key, min(coalesce(s.count, 0)) AS estimate FROM asked a LEFT JOIN sketch s
  ON a.model = s.model AND a.depth = s.depth AND a.bucket = s.bucket GROUP BY a.model, a.key""")
def sketch_estimates(spark, sf):
    log = t.access_log(spark, sf)
    return R.sketch_estimates(log, R.freq_sketch(log))


_W, _PROB, _PROT = R.segment_sizes(N)


@query("retain_segmented", f"""WITH {t.sql_access()}, {_freq(500)},
keys AS (SELECT a.model, a.key, count(*) FILTER (WHERE op = 'get') AS gets, max(seq) AS last,
    max(seq) FILTER (WHERE op = 'put') AS last_put, any_value(coalesce(f.frequency, 0)) AS frequency
  FROM access_log a LEFT JOIN frequency f ON a.model = f.model AND a.key = f.key GROUP BY a.model, a.key),
win AS (SELECT model, key FROM keys WHERE last_put IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY last_put DESC) <= {_W}),
rest AS (SELECT * FROM keys k ANTI JOIN win w ON k.model = w.model AND k.key = w.key),
prot AS (SELECT model, key FROM rest WHERE gets > 0
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY frequency DESC, last DESC) <= {_PROT}),
tail AS (SELECT * FROM rest k ANTI JOIN prot w ON k.model = w.model AND k.key = w.key),
prob AS (SELECT model, key FROM tail
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY frequency DESC, last DESC) <= {_PROB})
SELECT *, 'window' AS segment FROM win UNION ALL SELECT *, 'protected' FROM prot
UNION ALL SELECT *, 'probation' FROM prob""")
def retain_segmented(spark, sf):
    return R.retain_segmented(t.access_log(spark, sf), N, every=500)


@query("retain_recency_frequency", f"""WITH {t.sql_access()},
keys AS (SELECT model, key, count(*) AS n, max(seq) AS last FROM access_log GROUP BY ALL),
sizes AS (SELECT model, count(*) FILTER (WHERE n = 1) AS n1, count(*) FILTER (WHERE n > 1) AS n2 FROM keys GROUP BY model),
cuts AS (SELECT *, least(n2, {N} - least(n1, 60)) AS keep2, least(n1, {N} - least(n2, {N} - least(n1, 60))) AS keep1 FROM sizes),
placed AS (SELECT k.*, row_number() OVER (PARTITION BY k.model, n = 1 ORDER BY last DESC) AS place FROM keys k)
SELECT p.model, p.key, CASE WHEN n = 1 AND place <= keep1 THEN 't1' WHEN n = 1 THEN 'b1'
    WHEN place <= keep2 THEN 't2' ELSE 'b2' END AS segment
FROM placed p JOIN cuts c ON p.model = c.model
WHERE (n = 1 AND place <= keep1 + {N} - 60) OR (n > 1 AND place <= keep2 + 60)""")
def retain_recency_frequency(spark, sf):
    return R.retain_recency_frequency(t.access_log(spark, sf), N, 60)
