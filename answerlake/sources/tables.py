"""Entry table, query log and access log on parquet, and over JDBC."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake import schema as S
from answerlake.sources.vectors import encode_vectors


def read_entries(spark: SparkSession, path: str, models=None) -> DataFrame:
    """Live entries; a list of tenants prunes partitions."""
    entries = spark.read.schema(S.ENTRY).parquet(path).where(~F.col("is_deleted"))
    return entries if models is None else entries.where(F.col("model").isin(*models))


def write_entries(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per tenant, replacing only the tenants written.

    The rebalance hint lets adaptive execution split the files of a large
    tenant and join those of small ones. ``path`` must not be the folder the
    entries are read from: write a new folder and switch to it.
    """
    (entries.hint("rebalance", "model").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path))


def read_log(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Query log; ``since`` (a date) prunes the daily folders."""
    fields = T.StructType([*S.QUERY_LOG.fields, T.StructField("day", T.DateType())])
    log = spark.read.schema(fields).parquet(path)
    return log if since is None else log.where(F.col("day") >= F.lit(since).cast("date"))


def log_rows(responses: DataFrame) -> DataFrame:
    """Responses (with ts, model, query) as log rows; a list of hit questions is
    stored as JSON text."""
    hit_query = F.col("hit_query")
    if dict(responses.dtypes)["hit_query"].startswith("array"):
        hit_query = F.when(F.size("hit_query") > 0, F.to_json("hit_query")).otherwise("")
    return responses.select("request_id", "ts", "error_code", "error_desc", "cache_hit", "model",
                            "query", hit_query.alias("hit_query"), "answer", "delta_time")


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows under daily folders."""
    (rows.withColumn("day", F.to_date("ts")).hint("rebalance", "day")
     .write.mode("append").partitionBy("day").parquet(path))


def access_rows(stored: DataFrame = None, fetched: DataFrame = None,
                reloaded: DataFrame = None) -> DataFrame:
    """Accesses (model, key, op, at): a stored entry is a put, a fetched one a
    get, one loaded again after a miss a put. Each input has model, id and at."""
    out = None
    for frame, op in ((stored, "put"), (fetched, "get"), (reloaded, "put")):
        if frame is not None:
            rows = frame.select("model", F.col("id").alias("key"), F.lit(op).alias("op"), "at")
            out = rows if out is None else out.unionByName(rows)
    return out


def append_access_log(rows: DataFrame, path: str, start: int = 0) -> None:
    """Append accesses with an ascending unique ``seq`` from ``start`` on, in the
    order of ``at``. The sort is range-partitioned, the numbers need no single
    task; pass the log's last number plus one to continue it."""
    ordered = rows.orderBy("at", "model", "key", "op")
    (ordered.withColumn("seq", F.monotonically_increasing_id() + F.lit(start).cast("long"))
     .write.mode("append").parquet(path))


def jdbc_slices(column: str = "id") -> list:
    """Disjoint predicates for a parallel JDBC read that every id meets exactly one of.

    Ranges of the id as text, with open ends, that spread hexadecimal ids evenly; other
    ids fall between the same bounds, and null ids have a predicate of their own.
    """
    text, cuts = f"CAST({column} AS CHAR(255))", [f"{i:02x}" for i in range(1, 256)]
    ranges = [f"{text} >= '{a}' AND {text} < '{b}'" for a, b in zip(cuts, cuts[1:])]
    return [f"{text} < '{cuts[0]}'", *ranges, f"{text} >= '{cuts[-1]}'", f"{column} IS NULL"]


def read_jdbc_entries(spark: SparkSession, url: str, table: str, properties: dict) -> DataFrame:
    """Entry table of a MySQL-like store, read in slices of its ids. The database
    driver must be on the class path. Vectors that the store keeps as bytes stay bytes;
    see ``decode_vectors``."""
    rows = spark.read.jdbc(url, table, predicates=jdbc_slices(), properties=properties)
    return rows.where(F.col("is_deleted") == 0)


def append_jdbc_entries(entries: DataFrame, url: str, table: str, properties: dict) -> None:
    """Append entries in batches, one connection per task; vectors are stored as
    float32 bytes, as such a store keeps them."""
    encode_vectors(entries, "embedding").write.option("batchsize", 10_000).jdbc(url, table, "append", properties)
