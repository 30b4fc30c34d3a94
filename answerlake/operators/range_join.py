"""Exact threshold joins on squared distance over balls of vectors.

Distinct vectors of each (tenant, dimension) are put to the nearest of its pivots, about the
root of its rows, so that every pivot has a ball whose radius is measured. A request is sent
to a ball only if the triangle inequality lets a member be within the threshold: by the
ball's radius, and by the halves of space between its own pivot and the ball's. What is
written are counts and radii, no vectors. Where that sends the requests to more than
``REACH`` of all (request, entry) pairs, or tenants are so small that a tile holds them, the
vectors are joined by tiles of rows without pivots. Either way rows are those of brute force.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.operators.vector_join import TILE_ROWS, _by_dim, tile_matches
from answerlake.runtime import broadcast_if_small, few_rows, cut_lineage, salted_join, top_n

PIVOTS = 256
REACH = 0.5
SAMPLE = 1 << 30
SALTS, SALT_ROWS = 64, 1000
GROUP = ["_dim"]  # vectors of different dimensions are never near


def _vectors(df: DataFrame, by: list, id_col: str, vector: str) -> DataFrame:
    """(by..., _dim, _h, _g, _id, _v): vectors with two hashes that stand for equal vectors."""
    v = F.col(vector)
    return df.select(*by, F.col(id_col).alias("_id"), v.alias("_v")).where(F.size("_v") > 0).select(
        *by, F.size("_v").alias("_dim"), F.xxhash64("_v").alias("_h"), F.xxhash64(F.lit(7), "_v").alias("_g"), "_id", "_v")


def _distinct(vectors: DataFrame, by: list, out: str) -> DataFrame:
    """One row per distinct vector: its smallest id and the number of copies."""
    return vectors.groupBy(*by, *GROUP, "_h", "_g", "_v").agg(F.min("_id").alias(out), F.count(F.lit(1)).alias("copies"))


def _salts(copies: Column) -> Column:
    """Partitions over which the requests of one vector are spread."""
    return F.least(F.lit(SALTS), F.ceil(copies / F.lit(SALT_ROWS))).cast("int")


def _pivots(stored: DataFrame, sizes: DataFrame, by: list, most: int) -> DataFrame:
    """About the root of a group's distinct vectors, at most ``most``: those of least hash, drawn
    from the few whose hash lies in the share of its range that holds twice as many."""
    wanted = F.least(F.lit(most), F.ceil(F.sqrt(F.col("_e_rows"))))
    share = F.pmod("_h", F.lit(SAMPLE)) < F.lit(SAMPLE) * F.least(F.lit(1.0), (2 * wanted + 8) / F.col("_e_rows"))
    drawn = stored.join(sizes.select(*by, "_e_rows"), by).where(share).withColumn("_wanted", wanted)
    return (top_n(drawn, by, ["_h", "_g"], most, ["_g"], "_place").where(F.col("_place") <= F.col("_wanted"))
            .select(*by, "_v"))


class _Balls:
    """Pivots of each group, and later the radii of their balls; bounded, for broadcast."""

    def __init__(self, rows: pa.Table, by: list):
        self.by, self.centers, self.far = by, {}, {}
        for key, at in rows.select(by).to_pandas().groupby(by, sort=False).indices.items():
            found = _by_dim(pa.array(at), rows.take(pa.array(at))["_v"])
            if found:
                self.centers[key] = next(iter(found.values()))[1]

    def measured(self, cells: list):
        """Radii of the balls from rows (by..., _cell, far); others are empty."""
        self.far = {k: np.full(len(c), -np.inf) for k, c in self.centers.items()}
        for row in cells:
            self.far[tuple(row[c] for c in self.by)][row["_cell"]] = row["far"]
        return self

    def placed(self, batch: pa.Table):
        """For each group of a batch: key, rows, and their distances to the centers."""
        keys = batch.select(self.by).to_pandas().groupby(self.by, sort=False).indices
        for key, at in keys.items():
            for rows, m in _by_dim(pa.array(at), batch["_v"].take(pa.array(at))).values():
                c = self.centers.get(key)
                if c is None:
                    yield key, rows, np.zeros((len(rows), 1))
                else:
                    yield key, rows, np.sqrt(np.maximum((m * m).sum(1)[:, None] + (c * c).sum(1) - 2 * (m @ c.T), 0))

    def reached(self, key, d, radius):
        """The cells that can hold a match of each row; the slack covers rounding."""
        if radius is None:
            return d == d.min(axis=1, keepdims=True) if d.shape[1] == 1 else np.arange(d.shape[1]) == d.argmin(axis=1)[:, None]
        slack = np.sqrt(radius) + 1e-6 * (1 + d.max(initial=0))
        mask = (d - d.min(axis=1, keepdims=True)) / 2 <= slack
        return mask & (d <= self.far[key] + slack) if key in self.far else mask


def _with_cells(df: DataFrame, shared, radius=None) -> DataFrame:
    """A row for each cell of a vector, with the column _cell."""
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType())])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key, rows, d in shared.value.placed(table):
                at, cell = np.nonzero(shared.value.reached(key, d, radius))
                yield from table.take(pa.array(rows[at])).append_column("_cell", pa.array(cell.astype(np.int32))).to_batches()
    return df.mapInArrow(run, schema)


def _cell_sizes(df: DataFrame, shared, by: list, radius=None) -> DataFrame:
    """(by..., _cell, n, far): rows of each cell and their largest distance; one small row per
    cell and batch leaves a task."""
    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("_cell", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("far", T.DoubleType())])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key, rows, d in shared.value.placed(table):
                mask = shared.value.reached(key, d, radius)
                n, far = mask.sum(axis=0), np.where(mask, d, -np.inf).max(axis=0)
                cells = np.flatnonzero(n)
                one = table.select(by).take(pa.array(np.repeat(rows[:1], len(cells))))
                one = one.append_column("_cell", pa.array(cells.astype(np.int32)))
                yield from one.append_column("n", pa.array(n[cells])).append_column("far", pa.array(far[cells])).to_batches()
    return cut_lineage(df.select(*by, "_v").mapInArrow(run, schema).groupBy(*by, "_cell").agg(
        F.sum("n").alias("n"), F.max("far").alias("far")), "cell-sizes")


def _matches(asked: DataFrame, stored: DataFrame, by: list, radius: float, pivots: int, tile_rows: int,
             reach: float = REACH, **options) -> DataFrame:
    """Matches (by..., _q, _e, score) between distinct vectors, by balls where they pay."""
    by = [*by, *GROUP]
    # both sides may be one table, so one gets columns of its own
    q, e = asked.select(*[F.col(c).alias(c) for c in (*by, "_q", "_v")]), stored.select(*by, "_e", "_v")
    rows = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    sizes = cut_lineage(rows(q, "_q_rows").join(rows(e, "_e_rows"), by), "group-sizes")
    tiles = lambda: tile_matches(q, e, by, radius, tile_rows=tile_rows, counts=sizes, **options)
    if sizes.where((F.col("_q_rows") > tile_rows) | (F.col("_e_rows") > tile_rows)).isEmpty():
        return tiles()
    centers = cut_lineage(_pivots(stored, sizes, by, pivots), "pivots")
    if not few_rows(centers):
        return tiles()
    spark, balls = asked.sparkSession, _Balls(centers.toArrow(), by)
    context = spark.sparkContext
    own = _cell_sizes(e, context.broadcast(balls), by)
    if not few_rows(own):
        return tiles()
    shared = context.broadcast(balls.measured([r.asDict() for r in own.collect()]))
    sent = _cell_sizes(q, shared, by, radius)
    pairs = sent.select(*by, "_cell", F.col("n").alias("_q_rows")).join(
        own.select(*by, "_cell", F.col("n").alias("_e_rows")), [*by, "_cell"])
    joined = pairs.agg(F.sum(F.col("_q_rows") * F.col("_e_rows"))).first()[0] or 0
    every = sizes.agg(F.sum(F.col("_q_rows") * F.col("_e_rows"))).first()[0]
    if joined > reach * every:
        return tiles()
    return tile_matches(_with_cells(q, shared, radius), _with_cells(e, shared), [*by, "_cell"], radius,
                        tile_rows=tile_rows, counts=cut_lineage(pairs, "cell-pairs"), **options).drop("_cell")


def range_join(requests: DataFrame, entries: DataFrame, radius: float, by=("model",),
               request_id: str = "request_id", entry_id: str = "id", vector: str = "embedding",
               pivots: int = PIVOTS, tile_rows: int = TILE_ROWS, reach: float = REACH) -> DataFrame:
    """Entries within squared distance ``radius`` of each request, exact.

    Equal vectors are joined once: a result row names the smallest entry id of
    a vector and its number of ``copies``, so copies never multiply into pairs.
    """
    by = list(by)
    q = _vectors(requests, by, request_id, vector)
    stored = cut_lineage(_distinct(_vectors(entries, by, entry_id, vector), by, "_e"), "stored-vectors")
    asked = cut_lineage(_distinct(q, by, "_q").withColumn("_salts", _salts(F.col("copies"))).drop("copies"), "asked-vectors")
    found = _matches(asked, stored, by, radius, pivots, tile_rows, reach).drop("_dim")
    keys = [*by, *GROUP, "_h", "_g"]
    # the written side has a key once, so adaptive execution may split a hot vector of the other
    members = q.select(*keys, F.col("_id").alias(request_id)).join(asked.select(*keys, "_q", "_salts"), keys)
    members = members.withColumn("_salt", F.pmod(F.xxhash64(request_id), F.col("_salts")).cast("int"))
    per_entry = salted_join(found, stored.select(*by, "_e", "copies"), [*by, "_e"], "inner", spread=["_q"])
    # matches of a request are repeated only where many requests have its vector
    hot = cut_lineage(asked.where(F.col("_salts") > 1).select(*by, "_q", "_salts"), "hot-requests")
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    per_entry = per_entry.join(broadcast_if_small(hot), [*by, "_q"], "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return (members.select(*by, "_q", "_salt", request_id).join(per_entry, [*by, "_q", "_salt"])
            .select(*by, request_id, F.col("_e").alias(entry_id), "copies", "score"))


def semantic_dups(entries: DataFrame, radius: float, by=("model",), entry_id: str = "id",
                  vector: str = "embedding", pivots: int = PIVOTS,
                  tile_rows: int = TILE_ROWS, reach: float = REACH) -> DataFrame:
    """Entries with an earlier (smaller id) entry within squared distance
    ``radius``, with the smallest such id.

    Equal vectors collapse first, and a tile returns one row per entry, so a
    large group of copies costs no pairs.
    """
    by = list(by)
    e = _vectors(entries, by, entry_id, vector)
    distinct = cut_lineage(_distinct(e, by, "_e").drop("copies"), "vectors")
    near = _matches(distinct.withColumnRenamed("_e", "_q"), distinct, by, radius, pivots, tile_rows, reach, first_smaller=True)
    firsts = near.groupBy(*by, "_q").agg(F.min("_e").alias("first"))
    # A copy starts at its vector's smallest id; that row itself only has what
    # its neighbours offer.
    keys = [*by, *GROUP, "_h", "_g"]
    heads = cut_lineage(distinct.join(firsts.withColumnRenamed("_q", "_e"), [*by, "_e"], "left").select(
        *keys, F.least("_e", F.coalesce("first", "_e")).alias("first")), "heads")
    return (e.select(*keys, "_id").join(heads, keys).where(F.col("first") < F.col("_id"))
            .select(*by, F.col("_id").alias(entry_id), F.col("first").alias("duplicate_of")))
