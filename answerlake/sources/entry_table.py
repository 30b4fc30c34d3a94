"""Entry table whose changes are small deltas, merged when the table is read.

Deleting, counting hits and purging write no text and no vector. A folder holds

* ``data/part=N``: entries of write N by tenant, each row with its position ``pos``;
* ``marks/N``: bitmaps of positions (32 768 a bitmap) that were marked deleted or are gone;
* ``hits/N``: hits to add, by position;
* ``log/V.kinds.N``: version V is write N; a letter for each kind of change it holds.

A reader takes the last full version and all later ones. Bitmaps are tested row by row and
hits added while the files are scanned: both sides are broadcast, in as many slices of
positions as their measured bytes need, and a slice reads only the files of its positions.
So entries are never shuffled but by ``insert`` (the new ones) and ``compact`` (all, once).
Commits are exclusive: a write has folders of its own and takes its version by a lock file
that only one writer can make; the second fails, and may try again on the new version. Old
versions, failed writes and locks that they left stay until ``vacuum``.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake import schema as S
from answerlake.operators.maintain import fresh_entries, now
from answerlake.runtime import BROADCAST_BYTES, broadcast_if_small, cut_lineage, remove_folder

STORED = T.StructType([*S.ENTRY.fields, T.StructField("pos", T.LongType()), T.StructField("part", T.LongType())])
MARKS = "model string, part long, bucket long, gone boolean, bitmap binary"
HITS = "model string, part long, pos long, hits long, at timestamp_ntz"
BITMAP_BYTES, HIT_BYTES = 4096 + 64, 96
FULL, DATA, MARKED, HIT = "f", "d", "m", "h"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def folder_names(spark: SparkSession, path: str) -> list:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, target = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def _bit(bitmap: Column, pos: Column) -> Column:
    """Whether the bit of a position is set; a null bitmap has no bits."""
    at = F.bitmap_bit_position(pos)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def _bitmaps(rows: DataFrame, gone: bool) -> DataFrame:
    """Rows (model, part, pos) as bitmaps."""
    return rows.groupBy("model", "part", F.bitmap_bucket_number("pos").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap")).select(
        "model", "part", "bucket", F.lit(gone).alias("gone"), "bitmap")


class EntryTable:
    def __init__(self, spark: SparkSession, path: str, slice_bytes: int = BROADCAST_BYTES):
        self.spark, self.path, self.slice_bytes = spark, path.rstrip("/"), slice_bytes

    @classmethod
    def create(cls, spark: SparkSession, path: str, entries: DataFrame, **options) -> "EntryTable":
        table = cls(spark, path, **options)
        table._commit(table._next(), data=entries, full=True)
        return table

    # versions

    def _log(self) -> list:
        """(version, kinds, write) of the versions that a reader merges, in order."""
        names = [n.split(".") for n in folder_names(self.spark, f"{self.path}/log") if n.count(".") == 2]
        log = sorted((int(v), kinds, int(n)) for v, kinds, n in names)
        full = [i for i, (_, kinds, _) in enumerate(log) if FULL in kinds]
        return log[full[-1]:] if full else log

    def versions(self) -> dict:
        """Kinds of change of each write that a reader merges, in order."""
        return {n: kinds for _, kinds, n in self._log()}

    def _next(self) -> int:
        log = self._log()
        return log[-1][0] + 1 if log else 1

    def _commit(self, version: int, data: DataFrame = None, marks=None, hits: DataFrame = None, full: bool = False):
        """Write the parts of a version and log it. ``marks`` may be a function of the write's
        number that is called after its data were written."""
        kinds, n = "", uuid.uuid4().int >> 66
        if data is not None:
            (data.select(*S.ENTRY.names).hint("rebalance", "model")
             .withColumn("pos", F.monotonically_increasing_id() + 1)
             .write.partitionBy("model").parquet(f"{self.path}/data/part={n}"))
            kinds += FULL if full else DATA
        marks = marks(n) if callable(marks) else marks
        for rows, kind, name in ((marks, MARKED, "marks"), (hits, HIT, "hits")):
            if rows is not None:
                rows.write.parquet(f"{self.path}/{name}/{n}")
                kinds += kind
        fs, lock = _file_system(self.spark, f"{self.path}/log/{version:012d}")
        if not fs.createNewFile(lock):
            raise Conflict(f"version {version} of {self.path} is taken")
        fs.createNewFile(_file_system(self.spark, f"{self.path}/log/{version:012d}.{kinds}.{n}")[1])

    # reading

    def _data(self, models=None, versions=None) -> DataFrame:
        versions = self.versions() if versions is None else versions
        parts = [f"{self.path}/data/part={v}" for v, kinds in versions.items() if FULL in kinds or DATA in kinds]
        rows = self.spark.read.schema(STORED).option("basePath", f"{self.path}/data").parquet(*parts)
        return rows if models is None else rows.where(F.col("model").isin(*models))

    def _deltas(self, kind: str, name: str, schema: str, models, versions) -> DataFrame:
        paths = [f"{self.path}/{name}/{v}" for v, kinds in versions.items() if kind in kinds]
        if not paths:
            return None
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows if models is None else rows.where(F.col("model").isin(*models))

    def _merged_marks(self, models, versions) -> DataFrame:
        """(model, part, bucket, gone, marked): one bitmap of each kind for a bucket."""
        rows = self._deltas(MARKED, "marks", MARKS, models, versions)
        return rows if rows is None else rows.groupBy("model", "part", "bucket").agg(
            F.expr("bitmap_or_agg(bitmap) FILTER (WHERE gone)").alias("gone"),
            F.expr("bitmap_or_agg(bitmap) FILTER (WHERE NOT gone)").alias("marked"))

    def _beside(self, rows: DataFrame, deltas: DataFrame, on: list, first: Column, row_bytes: int) -> DataFrame:
        """Rows with the deltas of their keys, from broadcasts of at most about ``slice_bytes``.
        ``first`` is the least position that a delta is about."""
        deltas = cut_lineage(deltas.withColumn("_first", first), "deltas")
        size = deltas.count() * row_bytes
        slices = -(-size // self.slice_bytes) if size else 0
        if not slices:
            return None
        cuts = deltas.approxQuantile("_first", [i / slices for i in range(1, slices)], 1 / (4 * slices)) if slices > 1 else []
        # cuts fall between bitmaps, so that a bitmap is in one slice
        bounds = [None, *sorted({int(c) for c in cuts}), None]
        found = None
        for low, high in zip(bounds, bounds[1:]):
            inside = lambda c: ((F.lit(True) if low is None else c >= low)  # noqa: E731, B023
                                & (F.lit(True) if high is None else c < high))  # noqa: B023
            part = rows.where(inside(F.col("pos"))).join(
                F.broadcast(deltas.where(inside(F.col("_first"))).drop("_first")), on, "left")
            found = part if found is None else found.unionByName(part)
        return found

    def _marked(self, rows: DataFrame, models, versions) -> DataFrame:
        """Rows that are not gone, ``is_deleted`` with the marks."""
        marks = self._merged_marks(models, versions)
        bucket = rows.withColumn("bucket", F.bitmap_bucket_number("pos"))
        both = None if marks is None else self._beside(
            bucket, marks, ["model", "part", "bucket"], (F.col("bucket") - 1) * 32_768 + 1, 2 * BITMAP_BYTES)
        if both is None:
            return rows
        return (both.where(~_bit(F.col("gone"), F.col("pos")))
                .withColumn("is_deleted", F.col("is_deleted") | _bit(F.col("marked"), F.col("pos")))
                .drop("bucket", "gone", "marked"))

    def located(self, models=None, versions=None) -> DataFrame:
        """(model, id, part, pos, is_deleted) of the rows that are not gone; reads no text or vector."""
        versions = self.versions() if versions is None else versions
        rows = self._data(models, versions).select("model", "id", "part", "pos", "is_deleted")
        return self._marked(rows, models, versions)

    def read(self, models=None, deleted: bool = False, counters: bool = True) -> DataFrame:
        """Entries as they are now; ``deleted`` keeps the rows that are marked, and readers that
        need no hit counts spare their merge."""
        versions = self.versions()
        rows = self._marked(self._data(models, versions), models, versions)
        if not deleted:
            rows = rows.where(~F.col("is_deleted"))
        hits = self._deltas(HIT, "hits", HITS, models, versions) if counters else None
        if hits is not None:
            hits = hits.groupBy("model", "part", "pos").agg(F.sum("hits").alias("_hits"), F.max("at").alias("_at"))
            both = self._beside(rows, hits, ["model", "part", "pos"], F.col("pos"), HIT_BYTES)
            if both is not None:
                rows = (both.withColumn("hit_count", F.col("hit_count") + F.coalesce("_hits", F.lit(0)))
                        .withColumn("gmt_modified", F.coalesce("_at", "gmt_modified")))
        return rows.select(*S.ENTRY.names)

    # changes

    def _positions(self, ids: DataFrame, located: DataFrame) -> DataFrame:
        """Rows of (id) or (model, id), each key once, with the positions they are at."""
        keys = [c for c in ("model", "id") if c in ids.columns]
        ids = cut_lineage(ids.dropDuplicates(keys), "keys")
        return located.join(broadcast_if_small(ids), keys).select("model", "part", "pos", *[
            c for c in ids.columns if c not in keys])

    def soft_delete(self, ids: DataFrame) -> None:
        """Mark the given (id) or (model, id) deleted."""
        version = self._next()
        self._commit(version, marks=_bitmaps(self._positions(ids.select(*[
            c for c in ("model", "id") if c in ids.columns]), self.located()), False))

    def hard_delete(self, ids: DataFrame) -> None:
        """Drop the given (id) or (model, id)."""
        version = self._next()
        self._commit(version, marks=_bitmaps(self._positions(ids.select(*[
            c for c in ("model", "id") if c in ids.columns]), self.located()), True))

    def truncate(self, models: list) -> None:
        """Drop all rows of the given tenants."""
        version = self._next()
        self._commit(version, marks=_bitmaps(self.located(models).select("model", "part", "pos"), True))

    def _hits(self, responses: DataFrame, located: DataFrame, at: Column) -> DataFrame:
        keys = [F.col("hit_id").alias("id"), *([F.col("model")] if "model" in responses.columns else [])]
        hits = responses.where("cache_hit").groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
        return self._positions(hits, located).select(
            "model", "part", "pos", "hits", (now() if at is None else at).alias("at"))

    def add_hits(self, responses: DataFrame, at: Column = None) -> None:
        """Count the hits of responses (cache_hit, hit_id, optional model)."""
        version = self._next()
        self._commit(version, hits=self._hits(responses, self.located(), at))

    def purge(self) -> DataFrame:
        """Drop all marked rows; (model, purged), counted on bitmaps."""
        version, versions = self._next(), self.versions()
        stored = _bitmaps(self._data(None, versions).where("is_deleted").select("model", "part", "pos"), False)
        marks = self._deltas(MARKED, "marks", MARKS, None, versions)
        marks = cut_lineage(stored if marks is None else stored.unionByName(marks), "marks")
        any_ = F.bitmap_count(F.bitmap_or_agg("bitmap"))
        gone = F.bitmap_count(F.expr("bitmap_or_agg(bitmap) FILTER (WHERE gone)"))
        counts = (marks.groupBy("model", "part", "bucket").agg((any_ - gone).alias("n"))
                  .groupBy("model").agg(F.sum("n").alias("purged")).where("purged > 0"))
        self._commit(version, marks=marks.where("NOT gone").groupBy("model", "part", "bucket").agg(
            F.bitmap_or_agg("bitmap").alias("bitmap")).select("model", "part", "bucket", F.lit(True).alias("gone"), "bitmap"))
        return counts

    def _replaced(self, n: int, dead: DataFrame) -> DataFrame:
        """The marked rows whose id is among the new rows of a write."""
        ids = self.spark.read.schema(STORED).option("basePath", f"{self.path}/data").parquet(
            f"{self.path}/data/part={n}").select("id")
        return _bitmaps(self._positions(ids, dead), True)

    def insert(self, rows: DataFrame, **options) -> None:
        """Append new rows (see ``fresh_entries``). A row that is marked deleted gives way to a
        new one with its id."""
        version, located = self._next(), cut_lineage(self.located(), "located")
        dead = located.where("is_deleted")
        self._commit(version, data=fresh_entries(located, rows, **options),
                     marks=None if dead.isEmpty() else lambda n: self._replaced(n, dead))

    def apply(self, changes: dict, at: Column = None, **options) -> None:
        """The changes of a request batch (see ``handle_requests``) as one version: hits and
        removals see the table before the batch, then the inserts come."""
        version, located = self._next(), cut_lineage(self.located(), "located")
        removes = changes["removes"]
        tenants = cut_lineage(removes.where("remove_type = 'truncate_by_model'").select("model").distinct(), "tenants")
        listed = cut_lineage(removes.where("remove_type = 'delete_by_id'").select(
            "model", F.explode("id_list").alias("id")).distinct(), "listed")
        tenants, listed = broadcast_if_small(tenants), broadcast_if_small(listed)
        gone = located.join(tenants, "model", "left_semi")
        left = cut_lineage(located.join(tenants, "model", "left_anti")
                           .join(listed.withColumn("_listed", F.lit(True)), ["model", "id"], "left")
                           .withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_listed", F.lit(False))), "left")
        marks = lambda n: (_bitmaps(gone.select("model", "part", "pos"), True)
                         .unionByName(_bitmaps(left.where("_listed").select("model", "part", "pos"), False))
                         .unionByName(self._replaced(n, left.where("is_deleted"))))
        self._commit(version, data=fresh_entries(left, changes["inserts"], at=at, **options), marks=marks,
                     hits=self._hits(changes["hits"], located, at))

    def compact(self) -> None:
        """Fold all deltas into a new full version."""
        version = self._next()
        self._commit(version, data=self.read(deleted=True), full=True)

    def vacuum(self) -> None:
        """Delete what no reader of the newest version reads, and what was never committed. Not
        beside a writer."""
        versions, log = self.versions(), self._log()
        for kind, name in ((FULL + DATA, "data"), (MARKED, "marks"), (HIT, "hits")):
            for found in folder_names(self.spark, f"{self.path}/{name}"):
                if not set(kind) & set(versions.get(int(found.removeprefix("part=")), "")):
                    remove_folder(self.spark, f"{self.path}/{name}/{found}")
        kept = {f"{v:012d}.{kinds}.{n}" for v, kinds, n in log} | {f"{v:012d}" for v, _, _ in log}
        for found in set(folder_names(self.spark, f"{self.path}/log")) - kept:
            remove_folder(self.spark, f"{self.path}/log/{found}")
