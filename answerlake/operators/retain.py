"""Which entries to keep per tenant, from an access log (model, key, op, seq).

``seq`` is a unique integer. Accesses are first aggregated per key; groups are
then cut with a sliced top-n, so a tenant of any size is never sorted whole.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.runtime import SALTS, number_rows, top_n

KEY = ["model", "key"]


def key_statistics(log: DataFrame) -> DataFrame:
    """Per key: accesses, gets, puts, last access, last put."""
    put = F.col("op") == "put"
    return log.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("accesses"), F.count_if(~put).alias("gets"),
        F.count_if(put).alias("puts"), F.max("seq").alias("last_access"),
        F.max(F.when(put, F.col("seq"))).alias("last_put"))


def _keep(keys: DataFrame, order: list, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("the size must be positive")
    return top_n(keys, ["model"], order, n, ["key"]).select(*KEY, "position")


def retain_lru(log: DataFrame, n: int) -> DataFrame:
    """Keys with the latest access."""
    keys = log.groupBy(*KEY).agg(F.max("seq").alias("last"))
    return _keep(keys, [F.desc("last")], n)


def retain_fifo(log: DataFrame, n: int) -> DataFrame:
    """Keys with the latest put; gets do not count."""
    keys = log.where("op = 'put'").groupBy(*KEY).agg(F.max("seq").alias("last"))
    return _keep(keys, [F.desc("last")], n)


def retain_lfu(log: DataFrame, n: int) -> DataFrame:
    """Keys with the most accesses, ties by latest."""
    keys = log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    return _keep(keys, [F.desc("n"), F.desc("last")], n)


def retain_random(log: DataFrame, n: int, seed=0) -> DataFrame:
    """Keys at random, repeatable for a seed."""
    keys = log.select(*KEY).distinct()
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "model", "key"))
    return _keep(keys.withColumn("draw", draw), [F.asc("draw"), F.asc("key")], n)


SEGMENT = 32


def decayed_frequency(log: DataFrame, every: int = S.DECAY_EVERY) -> DataFrame:
    """Puts per key, where each completed block of ``every`` puts of the tenant
    halves the count so far, rounded down.

    Rounded halving composes: after blocks 0..c-1 the count is
    floor(sum(n_i * 2^i) / 2^c). Blocks are summed in segments of 32 (plain sums,
    aggregated before the shuffle); only the segment totals of a key are folded
    in order.
    """
    puts = log.where("op = 'put'").select("model", "key", "seq")
    placed = number_rows(puts, ["model"], "seq", "place", "puts")
    segments = (placed.select(*KEY, F.expr(f"(place - 1) div {every}").alias("block"),
                              F.expr(f"puts div {every}").alias("done"))
                .select(*KEY, "done", F.expr(f"block div {SEGMENT}").alias("segment"),
                        F.expr(f"shiftleft(1L, cast(block % {SEGMENT} as int))").alias("weight"))
                .groupBy(*KEY, "segment").agg(F.sum("weight").alias("total"),
                                              F.max("done").alias("done")))
    per_key = segments.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("segment", "total"))).alias("parts"),
        F.max("done").alias("done"))

    def carried(state, segment):
        # after a segment a count is at most ``every``, so a second one clears it
        gap = segment - state["segment"]
        return (F.when(gap == 0, state["total"])
                .when(gap == 1, F.shiftright(state["total"], SEGMENT)).otherwise(F.lit(0).cast("long")))

    start = F.struct(F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("total"))
    folded = F.aggregate("parts", start, lambda s, p: F.struct(
        p["segment"].alias("segment"), (carried(s, p["segment"]) + p["total"]).alias("total")))
    last = F.expr(f"done div {SEGMENT}")
    return (per_key.withColumn("state", folded)
            .withColumn("left", carried(F.col("state"), last))
            .select(*KEY, F.expr(f"shiftright(left, cast(done % {SEGMENT} as int))").alias("frequency")))


def _buckets(keys: DataFrame, width: int, depth: int) -> DataFrame:
    rows = keys.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    digest = F.substring(F.md5(F.concat_ws(":", "depth", "key")), 1, 8)
    return rows.withColumn("bucket", (F.conv(digest, 16, 10).cast("long") % width).cast("int"))


def freq_sketch(log: DataFrame, width: int = S.SKETCH_WIDTH,
                depth: int = S.SKETCH_DEPTH) -> DataFrame:
    """Count-min table of puts: (model, depth, bucket, count)."""
    counts = log.where("op = 'put'").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return (_buckets(counts, width, depth).groupBy("model", "depth", "bucket")
            .agg(F.sum("n").alias("count")))


def sketch_estimates(keys: DataFrame, sketch: DataFrame, width: int = S.SKETCH_WIDTH,
                     depth: int = S.SKETCH_DEPTH) -> DataFrame:
    """Estimated puts of each key: the least of its buckets (0 when empty)."""
    asked = _buckets(keys.select(*KEY).distinct(), width, depth)
    found = asked.join(sketch, ["model", "depth", "bucket"], "left")
    return found.groupBy(*KEY).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def segment_sizes(n: int, window_share: float = 0.01) -> tuple:
    """(window, probation, protected) sizes."""
    if not 0 <= window_share <= 1:
        raise ValueError("the window share lies in 0..1")
    window = max(1, int(n * window_share))
    rest = n - window
    return window, rest // 2, rest - rest // 2


def retain_segmented(log: DataFrame, n: int, window_share: float = 0.01,
                     every: int = S.DECAY_EVERY) -> DataFrame:
    """Window, protected and probation segments.

    Window: latest puts. Protected: keys read at least once, by decayed
    frequency. Probation: the next keys by decayed frequency. Ties go to the
    later access. Each segment can only hold keys near the top of its own order,
    so every hash slice of a tenant is first cut to at most three times ``n``
    candidates.
    """
    window, probation, protected = segment_sizes(n, window_share)
    keys = (key_statistics(log).join(decayed_frequency(log, every), KEY, "left")
            .withColumn("frequency", F.coalesce("frequency", F.lit(0).cast("long")))
            .select(*KEY, "gets", "frequency", "last_access", "last_put"))
    frequent = [F.desc("frequency"), F.desc("last_access")]
    sliced = keys.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    slice_ = Window.partitionBy("model", "_salt")
    by_put = [F.col("last_put").desc_nulls_last()]
    was_read = F.col("gets") > 0
    candidates = (sliced
                  .withColumn("_put", F.row_number().over(slice_.orderBy(*by_put)))
                  .withColumn("_all", F.row_number().over(slice_.orderBy(*frequent)))
                  .withColumn("_read", F.row_number().over(
                      slice_.orderBy(was_read.desc(), *frequent)))
                  .where((F.col("_put") <= window) | (F.col("_all") <= n)
                         | (was_read & (F.col("_read") <= window + protected)))
                  .drop("_salt", "_put", "_all", "_read"))
    put_place = F.row_number().over(Window.partitionBy("model").orderBy(*by_put))
    marked = candidates.withColumn("segment", F.when(
        F.col("last_put").isNotNull() & (put_place <= window), "window"))

    def next_segment(df, rule, size, name):
        free = F.col("segment").isNull() & rule
        place = F.row_number().over(Window.partitionBy("model", free).orderBy(*frequent))
        return df.withColumn("_place", place).withColumn("segment", F.when(
            free & (F.col("_place") <= size), name).otherwise(F.col("segment"))).drop("_place")

    marked = next_segment(marked, F.col("gets") > 0, protected, "protected")
    marked = next_segment(marked, F.lit(True), probation, "probation")
    return marked.where("segment is not null").select(*KEY, "segment")


def retain_recency_frequency(log: DataFrame, n: int, target: int) -> DataFrame:
    """Lists t1 (keys accessed once) and t2 (more often), both by last access,
    with the next keys after each cut as ghosts b1 and b2.

    ``target`` is the aimed size of t1: keep2 = min(|t2|, n - min(|t1|, target)),
    keep1 = min(|t1|, n - keep2); ghosts are at most n - target and target.
    """
    if not 0 <= target <= n:
        raise ValueError("the target lies in 0..n")
    keys = (log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("accesses"), F.max("seq").alias("last"))
            .select(*KEY, "last", F.when(F.col("accesses") == 1, 1).otherwise(2).alias("list")))
    sizes = keys.groupBy("model").agg(
        F.count_if(F.col("list") == 1).alias("n1"), F.count_if(F.col("list") == 2).alias("n2"))
    # a list keeps at most n keys and n ghosts
    ordered = top_n(keys, ["model", "list"], [F.desc("last")], 2 * n, ["key"])
    keep2 = F.least("n2", n - F.least("n1", F.lit(target)))
    cut = (ordered.join(sizes, "model").withColumn("keep2", keep2)
           .withColumn("keep1", F.least("n1", n - F.col("keep2"))))
    one, place = F.col("list") == 1, F.col("position")
    segment = (F.when(one & (place <= F.col("keep1")), "t1")
               .when(one & (place <= F.col("keep1") + (n - target)), "b1")
               .when(~one & (place <= F.col("keep2")), "t2")
               .when(~one & (place <= F.col("keep2") + target), "b2"))
    return cut.select(*KEY, segment.alias("segment")).where("segment is not null")
