"""Reports over the query log, the timing table and the entry table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.runtime import broadcast_if_small, cut_lineage, hot_join

PERCENTILE_ROWS = 1 << 20


def report_totals(op_times: DataFrame, log: DataFrame) -> DataFrame:
    """Per tenant: embedding and search counts, times and averages, and hits."""
    def part(op):
        mine = F.col("op") == op
        return [F.count_if(mine).alias(f"{op}_count"),
                F.coalesce(F.sum(F.when(mine, F.col("seconds"))), F.lit(0.0)).alias(f"{op}_time")]

    times = op_times.groupBy("model").agg(*part("embedding"), *part("search"))
    hits = log.groupBy("model").agg(F.count_if("cache_hit").alias("hits"))
    both = times.join(hits, "model", "full").na.fill(0)
    average = lambda op: F.when(F.col(f"{op}_count") > 0, F.round(
        F.col(f"{op}_time") / F.col(f"{op}_count"), 4)).otherwise(0.0).alias(f"average_{op}_time")
    return both.select("*", average("embedding"), average("search"))


def hit_rate_by_model(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("cache_hit").alias("hits"),
        F.avg(F.col("cache_hit").cast("int")).alias("hit_rate"))


def error_breakdown(log: DataFrame) -> DataFrame:
    return log.groupBy("model", "error_code").agg(F.count(F.lit(1)).alias("rows"))


def _matched(left: DataFrame, right: DataFrame, on: list, also=None) -> DataFrame:
    """Inner join that takes nulls of the keys as equal; keys of the left stay."""
    other = right.select(*[F.col(c).alias(f"_of_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return left.join(other, [*same, *([] if also is None else [also])]).drop(*[f"_of_{c}" for c in on])


def exact_percentiles(rows: DataFrame, by: list, value: str, probabilities: list,
                      task_rows: int = PERCENTILE_ROWS) -> DataFrame:
    """Per group: rows with a value, their mean, and exact interpolated percentiles ``p`` (an
    array), without a buffer or a sort that grows with a group.

    Equal values are counted first. More than ``task_rows`` counts are sorted over the cluster in
    ranges of about that size, whose sums, added up in order, tell which range holds a wanted
    rank; only rows of these ranges are then numbered. Null values are left out; NaN is the largest.
    """
    counted = (rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")))
    counts = cut_lineage(counted, "value-counts")
    ranges = -(-counts.count() // task_rows)
    if ranges <= 1:  # measured to fit a buffer
        share = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_n"))
        return counts.groupBy(*by).agg(
            F.sum("_n").alias("rows"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), share.alias("p"))
    placed = cut_lineage(counts.repartitionByRange(ranges, *by, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*by, "_range").agg(
        F.sum("_n").alias("_rows"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut_lineage(sums.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "range-sums")
    totals = sums.groupBy(*by).agg(F.sum("_rows").alias("rows"), (F.sum("_sum") / F.sum("_rows")).alias("mean"))
    # ranks on both sides of each percentile, from 0
    at = [(F.col("rows") - 1) * F.lit(float(p)) for p in probabilities]
    wanted = totals.select(*by, "rows", "mean", F.posexplode(F.array(*at)).alias("_p", "_at")).withColumns(
        {"_low": F.floor("_at"), "_high": F.ceil("_at")})
    ranks = wanted.select(*by, F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_rank")).distinct()
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rows"))
    found = cut_lineage(_matched(sums, ranks, by, inside).select(*by, "_range", "_before", "_rank"), "wanted-ranges")
    used = broadcast_if_small(found.select(*by, "_range", "_before").distinct())
    running = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = (_matched(placed, used, [*by, "_range"]).withColumn("_end", F.col("_before") + F.sum("_n").over(running))
            .withColumn("_start", F.col("_end") - F.col("_n")).drop("_before"))
    holds = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    at_rank = _matched(ends, broadcast_if_small(found.drop("_before")), [*by, "_range"], holds).select(*by, "_rank", "_v")
    side = lambda name, rank: _matched(wanted, at_rank, by, F.col(rank) == F.col("_rank")).select(
        *by, "rows", "mean", "_p", (F.col("_at") - F.col("_low")).alias("_share"), F.col("_v").alias(name))
    both = side("_a", "_low").withColumn("_b", F.lit(None).cast("double")).unionByName(
        side("_b", "_high").withColumn("_a", F.lit(None).cast("double")))
    return (both.groupBy(*by, "rows", "mean", "_p").agg(
        F.max("_share").alias("_share"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .withColumn("_x", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
            F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")))
        .groupBy(*by, "rows", "mean").agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("p"))
        .select(*by, "rows", "mean", F.col("p._x").alias("p")))


def latency_by_hit(log: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, median and 95th percentile of latency for hits and misses; the exact form holds
    no group in one place (``exact_percentiles``)."""
    if not exact:
        p = F.percentile_approx("delta_time", [0.5, 0.95], 10_000)
        return log.groupBy("cache_hit").agg(
            F.count(F.lit(1)).alias("rows"), F.avg("delta_time").alias("mean"),
            p[0].alias("p50"), p[1].alias("p95"))
    found = exact_percentiles(log.select("cache_hit", F.col("delta_time").cast("double").alias("delta_time")),
                              ["cache_hit"], "delta_time", [0.5, 0.95])
    return found.select("cache_hit", "rows", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def service_speedup(cached: DataFrame, direct: DataFrame) -> DataFrame:
    """The same requests with and without the cache: time ratio and agreement
    (both: request_id, delta_time, answer; cached also model)."""
    other = direct.select("request_id", F.col("delta_time").alias("_time"),
                          F.col("answer").alias("_answer"))
    return cached.join(other, "request_id").groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum("_time") / F.sum("delta_time")).alias("speedup"),
        F.avg((F.col("answer") == F.col("_answer")).cast("int")).alias("agreement"))


def top_hit_entries(entries: DataFrame, n: int) -> DataFrame:
    """Entries whose hit count is among a tenant's ``n`` largest counts.

    Only the different counts of a tenant are ranked; entries are then joined to
    the few ranked counts, so no tenant's entries are sorted.
    """
    counts = entries.select("model", "hit_count").distinct()
    place = F.dense_rank().over(Window.partitionBy("model").orderBy(F.desc("hit_count")))
    ranked = counts.withColumn("place", place).where(F.col("place") <= n)
    return entries.select("model", "id", "hit_count").join(
        broadcast_if_small(ranked), ["model", "hit_count"])


def cold_entries(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Entries that no logged hit returned (log: cache_hit, hit_id)."""
    hit = log.where("cache_hit").select(F.col("hit_id").alias("id")).distinct()
    return entries.join(hit, "id", "left_anti")


def hit_query_recall(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Logged hits beside the entry they returned; entries may be hot."""
    hits = log.where("cache_hit").select("log_id", "query", F.col("hit_id").alias("id"))
    return hot_join(hits, entries.select("id", "question", "answer"), ["id"], spread=["log_id"])


def hit_rate_over_time(log: DataFrame, hours: int = 24) -> DataFrame:
    """Hourly hit rate per tenant and its moving rate over the last hours with
    rows."""
    hourly = log.groupBy("model", F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("cache_hit").alias("hits"))
    last = Window.partitionBy("model").orderBy("hour").rowsBetween(-(hours - 1), 0)
    return hourly.select("model", F.col("w.start").alias("hour"), "queries", "hits").select(
        "*", (F.col("hits") / F.col("queries")).alias("hit_rate"),
        (F.sum("hits").over(last) / F.sum("queries").over(last)).alias("moving_rate"))


def log_cube(log: DataFrame) -> DataFrame:
    """Counts by tenant, hit and error code with all subtotals."""
    return log.cube("model", "cache_hit", "error_code").agg(
        F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("level"))


def threshold_sweep(nearest: DataFrame, thresholds: list) -> DataFrame:
    """Hits, right hits and precision for each threshold and length class.

    ``nearest`` has rank, id, truth, text_class: one search serves all
    thresholds.
    """
    asked = nearest.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    hit = F.col("rank") >= F.col("threshold")
    right = hit & (F.col("id") == F.col("truth"))
    out = asked.groupBy("threshold", "text_class").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(hit).alias("hits"),
        F.count_if(right).alias("right_hits"))
    return out.withColumn("precision", F.when(
        F.col("hits") > 0, F.col("right_hits") / F.col("hits")))


def distinct_queries(log: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct prompts per tenant. The exact form first removes repeats by
    (tenant, prompt), which spreads a large tenant."""
    if exact:
        return (log.select("model", "query").distinct().groupBy("model")
                .agg(F.count("query").alias("queries")))
    return log.groupBy("model").agg(F.approx_count_distinct("query", 0.02).alias("queries"))
