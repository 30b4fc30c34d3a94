"""Session helpers shared by the operators: shared folders, checked broadcasts,
skew-safe top-n and row numbering."""

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
SALTS = 64
_scratch = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder.

    Only a local session without the setting may fall back to a temporary
    folder, which is then kept for the rest of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="answerlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scratch.get() is not None:
        _scratch.get().append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Folders that ``shared_dir`` names inside are deleted at the end, whether or not
    the work succeeds; write what is to stay before, and elsewhere."""
    paths = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            remove_folder(spark, path)


def cut_lineage(df: DataFrame, name: str, folder: str = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to one below it, and read it back."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that no frame reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _row_bytes(df: DataFrame):
    """Approximate bytes of a row: texts by length, number arrays by elements."""
    total = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size = F.size(c) * 8
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(0)
        total = total + F.coalesce(size, F.lit(0)) + 8
    return total


def few_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = None) -> bool:
    """Whether a frame was measured to have at most ``max_rows`` rows and
    ``max_bytes`` bytes. The rows of a limit meet in one task, so only their sizes go there."""
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    sizes = df.select(_row_bytes(df).cast("long").alias("bytes"))
    rows, size = sizes.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after measuring that the rows fit the bound.

    Above the bound the frame is returned as it is, so the join shuffles and
    adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if few_rows(df, max_rows) else df


def salted_join(left: DataFrame, right: DataFrame, on: list, how: str = "inner",
                spread: list = None, salts: int = 8) -> DataFrame:
    """Shuffle join whose left keys may be hot (``how``: inner or left).

    Left rows of one key are spread over ``salts`` partitions by the ``spread``
    columns; the right side is repeated once per salt.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*(spread or left.columns)),
                                             F.lit(salts)).cast("int"))
    repeated = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, on: list, how: str = "inner",
             spread: list = None, reduce=lambda rows: rows) -> DataFrame:
    """Join to a table that, after ``reduce``, has at most one row per key, from
    rows that may repeat a key often.

    Few different keys: they are broadcast to cut the table, and what is found
    is written once and, if measured small too, broadcast to the rows, so
    nothing is shuffled. Otherwise the join is salted.
    """
    wanted = left.select(*on).distinct()
    if few_rows(wanted):
        found = cut_lineage(reduce(right.join(F.broadcast(wanted), on, "left_semi")), "found")
        if few_rows(found):
            return left.join(F.broadcast(found), on, how)
        return salted_join(left, found, on, how, spread)
    return salted_join(left, reduce(right).join(wanted, on, "left_semi"), on, how, spread)


def top_n(df: DataFrame, by: list, order: list, n, spread: list,
          position: str = "position", salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of each group in ``order``; exact for hot groups.

    A group is first cut to ``n`` rows inside each of ``salts`` hash slices, so
    the last sort of a group sees at most ``n * salts`` rows.
    """
    sliced = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    local = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = (sliced.withColumn(position, F.row_number().over(local))
            .where(F.col(position) <= n).drop("_salt"))
    total = Window.partitionBy(*by).orderBy(*order)
    return (kept.withColumn(position, F.row_number().over(total))
            .where(F.col(position) <= n))


def number_rows(df: DataFrame, by: list, seq: str, out: str, total: str = None,
                width: int = 65_536) -> DataFrame:
    """1-based position of each row in its group, ordered by the unique integer
    ``seq``, without sorting a whole group in one task; ``total`` names a column
    for the size of the group.

    Rows are numbered inside blocks of ``width`` consecutive ``seq`` values (so
    no block exceeds ``width`` rows) and shifted by the rows of earlier blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(seq) / F.lit(width)).cast("long"))
    sizes = blocked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []))
    inside = Window.partitionBy(*by, "_block").orderBy(seq)
    return (blocked.withColumn("_in", F.row_number().over(inside))
            .join(offsets, [*by, "_block"])
            .withColumn(out, F.col("_in") + F.col("_before"))
            .drop("_block", "_in", "_before"))
