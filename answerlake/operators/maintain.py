"""Entry-table maintenance. Every operator returns new frames; writing is
``sources.tables.write_entries`` to a new folder."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.functions.vectors import l2_normalize
from answerlake.runtime import broadcast_if_small, cut_lineage


def now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def content_id(model: Column, key: Column, answer: Column, *image: Column) -> Column:
    """The same (tenant, key, answer) always gets the same id, so a repeated
    insert adds nothing. Of multimodal rows, ``image`` columns (kind, url, image id, hash
    of a raw image) that are not null are part of the content."""
    parts = F.array_compact(F.array(*[F.concat(F.lit(f"{i}="), c) for i, c in enumerate(image)])) if image else F.array()
    return F.sha2(F.concat_ws("\x1f", model, key, answer, parts), 256)


def assign_ids(rows: DataFrame, kind: str = "content") -> DataFrame:
    """Add ``id``: content hash, random uuid, or ascending number."""
    image = [F.col(c) for c in ("mm_type", "image_url", "image_id", "image_hash") if c in rows.columns]
    ids = {"content": content_id(F.col("model"), F.col("question"), F.col("answer"), *image),
           "uuid": F.expr("uuid()"),
           "ascending": F.monotonically_increasing_id().cast("string")}
    return rows.withColumn("id", ids[kind])


def zip_columns(rows: DataFrame, names=("questions", "answers", "embeddings")) -> tuple:
    """(one row per position of the arrays, rejects whose lengths differ)."""
    first, *others = names
    same = F.lit(True)
    for n in others:
        same = same & (F.size(n) == F.size(first))
    rest = [c for c in rows.columns if c not in names]
    good = (rows.where(same).select(*rest, F.posexplode(F.arrays_zip(*names)).alias("pos", "z"))
            .select(*rest, "pos", *[F.col(f"z.{n}").alias(n.removesuffix("s")) for n in names]))
    return good, rows.where(~F.coalesce(same, F.lit(False)))


def new_entries(rows: DataFrame, normalize: bool = True, at: Column = None) -> DataFrame:
    """Rows (model, question, answer, embedding, optional answer_type, mm_type,
    image_url, image_id) in the entry schema with default states. Vectors become
    unit float32; rows whose vector is missing or zero are left out (see
    ``rejected_vectors``)."""
    for name, default in (("mm_type", None), ("image_url", None), ("image_id", None),
                          ("answer_type", S.ANSWER_TEXT)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(default).cast(S.ENTRY[name].dataType))
    if "id" not in rows.columns:
        rows = assign_ids(rows)
    vector = l2_normalize(F.col("embedding")) if normalize else F.col("embedding")
    at = now() if at is None else at
    ready = (rows.withColumn("embedding", vector).where(F.col("embedding").isNotNull())
             .withColumn("hit_count", F.lit(0)).withColumn("is_deleted", F.lit(False))
             .withColumn("gmt_create", at).withColumn("gmt_modified", at))
    return ready.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.ENTRY])


def rejected_vectors(rows: DataFrame) -> DataFrame:
    return rows.where(l2_normalize(F.col("embedding")).isNull())


def fresh_entries(entries: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """The entries of ``rows`` whose id the table does not hold live; append these.

    The rows are made once and written; few new ids are broadcast to the scan of the
    table's ids, and vectors take no part in the check.
    """
    from answerlake.operators.lookup import keep_wanted
    new = cut_lineage(new_entries(rows, **options).dropDuplicates(["id"]), "new-entries")
    live = entries.where(~F.col("is_deleted")) if "is_deleted" in entries.columns else entries
    known = keep_wanted(live.select("id"), new.select("id"), ["id"])
    return new.join(known, "id", "left_anti").select(*S.ENTRY.names)


def insert_entries(entries: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """The table with the new rows. Live ids already there are kept as they are; a row
    marked as deleted gives way to a new one with its id."""
    table, fresh = entries.select(*S.ENTRY.names), fresh_entries(entries, rows, **options)
    dead = table.where("is_deleted").join(fresh.select("id"), "id", "left_anti").select(*S.ENTRY.names)
    return table.where(~F.col("is_deleted")).unionByName(dead).unionByName(fresh)


def apply_hit_counts(entries: DataFrame, responses: DataFrame, at: Column = None) -> DataFrame:
    """Add the hits of a response batch to each returned entry's counter."""
    hits = broadcast_if_small(responses.where("cache_hit").groupBy(F.col("hit_id").alias("id"))
                              .agg(F.count(F.lit(1)).alias("_hits")))
    hit = F.col("_hits").isNotNull()
    return (entries.join(hits, "id", "left")
            .withColumn("hit_count", F.col("hit_count") + F.coalesce("_hits", F.lit(0)))
            .withColumn("gmt_modified", F.when(hit, now() if at is None else at)
                        .otherwise(F.col("gmt_modified")))
            .drop("_hits").select(*entries.columns))


def soft_delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark the given ids deleted."""
    marked = broadcast_if_small(ids.select("id").distinct()).withColumn("_marked", F.lit(True))
    return (entries.join(marked, "id", "left")
            .withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_marked", F.lit(False)))
            .drop("_marked").select(*entries.columns))


def hard_delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the given ids outright."""
    gone = broadcast_if_small(ids.select("id").distinct())
    return entries.join(gone, "id", "left_anti").select(*entries.columns)


def truncate_model(entries: DataFrame, log: DataFrame, models: list) -> tuple:
    """(entries, log, removed entry count by tenant) without the given tenants."""
    gone = F.col("model").isin(*models)
    counts = entries.where(gone).groupBy("model").agg(F.count(F.lit(1)).alias("delete_count"))
    return entries.where(~gone), log.where(~gone), counts


def purge_deleted(entries: DataFrame) -> tuple:
    """(live entries, number of purged rows by tenant)."""
    purged = entries.where("is_deleted").groupBy("model").agg(F.count(F.lit(1)).alias("purged"))
    return entries.where(~F.col("is_deleted")), purged


def compact_entries(entries: DataFrame, path: str) -> None:
    """Rewrite the live rows to a new folder in evenly sized files."""
    from answerlake.sources.tables import write_entries
    write_entries(purge_deleted(entries)[0], path)


def ids_by_state(entries: DataFrame, deleted: bool = True) -> DataFrame:
    return entries.where(F.col("is_deleted") == deleted).select("id")


def count_by_state(entries: DataFrame) -> DataFrame:
    """Per tenant: all rows, live rows, marked rows."""
    return entries.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_deleted")).alias("live"),
        F.count_if("is_deleted").alias("marked"))


def check_evict(entries: DataFrame, max_marked: int = S.PURGE_MARKED,
                max_rate: float = S.PURGE_RATE) -> DataFrame:
    """Per tenant, whether marked rows are so many that a purge is due."""
    return count_by_state(entries).withColumn(
        "purge", (F.col("marked") > max_marked) | (F.col("marked") / F.col("total") > max_rate))


def register_collections(wanted: DataFrame, collections: DataFrame, dim: int,
                         metric: str = "l2") -> tuple:
    """(status of each wanted (model, mm_type), collections with the new ones).

    Status is create_success, already_exists, or error 502 for an empty tenant.
    """
    keys = ["model", "mm_type"]
    asked = wanted.select(*keys).distinct()
    # a null kind is a key of its own, so both sides are compared null-safe
    known = broadcast_if_small(collections.select(*[F.col(k).alias(f"_{k}") for k in keys],
                                                  F.lit(True).alias("_known")))
    match = F.col("model").eqNullSafe(F.col("_model")) & F.col("mm_type").eqNullSafe(F.col("_mm_type"))
    empty = F.coalesce(F.col("model"), F.lit("")) == ""
    status = asked.join(known, match, "left").select(
        *keys, F.when(empty, S.REGISTER_FAILED).otherwise(S.OK).alias("error_code"),
        F.when(empty, F.lit(None)).when(F.col("_known"), "already_exists")
        .otherwise("create_success").alias("response"))
    created = status.where("response = 'create_success'").select(
        *keys, F.lit(dim).alias("dim"), F.lit(metric).alias("metric"))
    return status, collections.select(*keys, "dim", "metric").unionByName(created)


def remove_status(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Status rows of remove requests (request_id, model, remove_type, id_list).

    delete_by_id counts the listed ids present in the tenant, truncate_by_model
    the tenant's rows; other kinds are error 401.
    """
    by_id = requests.where("remove_type = 'delete_by_id'")
    ids = by_id.select("request_id", "model", F.explode(F.array_distinct("id_list")).alias("id"))
    found = (ids.join(entries.select("model", "id"), ["model", "id"], "left_semi")
             .groupBy("request_id").agg(F.count(F.lit(1)).alias("delete_count")))
    sizes = broadcast_if_small(entries.groupBy("model").agg(F.count(F.lit(1)).alias("_rows")))
    done = (requests.join(found, "request_id", "left").join(sizes, "model", "left")
            .withColumn("delete_count", F.coalesce(
                F.when(F.col("remove_type") == "truncate_by_model", F.col("_rows"))
                .otherwise(F.col("delete_count")), F.lit(0))))
    known = F.coalesce(F.col("remove_type").isin(*S.REMOVE_TYPES), F.lit(False))
    return done.select(
        "request_id", F.when(known, S.OK).otherwise(S.REMOVE_INVALID).alias("error_code"),
        F.when(known, "success").otherwise("failed").alias("status"),
        F.when(known, F.col("delete_count")).otherwise(F.lit(0)).alias("delete_count"))
