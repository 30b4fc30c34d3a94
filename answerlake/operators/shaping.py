"""Validate, filter and route request rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.functions.text import mm_type, normalize_model


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``model`` and ``error_code``: a scope without a tenant is 103, a missing or
    unknown verb 102, then a missing scope 103 and an unknown removal kind 401; an
    earlier error stays. Without the column ``has_scope`` a row without tenant has no scope."""
    verb, no_model = F.col("type"), F.col("raw_model").isNull()
    scope = F.col("has_scope") if "has_scope" in requests.columns else F.lit(False)
    code = (F.when(no_model & F.coalesce(scope, F.lit(False)), S.BAD_PARAMS)
            .when(verb.isNull() | ~verb.isin(*S.VERBS), S.BAD_TYPE)
            .when(no_model, S.BAD_PARAMS)
            .when((verb == "remove") & ~F.coalesce(F.col("remove_type").isin(*S.REMOVE_TYPES),
                                                   F.lit(False)), S.REMOVE_INVALID)
            .otherwise(S.OK))
    if "error_code" in requests.columns:
        code = F.when(F.col("error_code") != S.OK, F.col("error_code")).otherwise(code)
    return (requests.withColumn("model", normalize_model(F.col("raw_model")))
            .withColumn("error_code", code))


def blacklist_filter(requests: DataFrame, blocked=S.BLACKLIST) -> DataFrame:
    """Blocked tenants may not query (105) or insert (305)."""
    barred = F.col("model").isin(*blocked)
    code = (F.when(F.col("error_code") != S.OK, F.col("error_code"))
            .when(barred & (F.col("type") == "query"), S.QUERY_BLOCKED)
            .when(barred & (F.col("type") == "insert"), S.INSERT_BLOCKED)
            .otherwise(S.OK))
    return requests.withColumn("error_code", code).withColumn("error_desc", F.when(
        F.col("error_code").isin(S.QUERY_BLOCKED, S.INSERT_BLOCKED),
        F.concat(F.lit("model: "), F.col("model"), F.lit(" in blacklist"))).otherwise(""))


def read_by_verb(requests: DataFrame, readers: dict) -> DataFrame:
    """Payload columns are left null where no route reads them; ``readers`` names the verb of each."""
    good = F.col("error_code") == S.OK
    return requests.withColumns({c: F.when(good & (F.col("type") == verb), F.col(c)) for c, verb in readers.items()})


def route_requests(requests: DataFrame) -> dict:
    """One frame per verb and one of rejects, as filters over one scan."""
    good = F.col("error_code") == S.OK
    routes = {verb: requests.where(good & (F.col("type") == verb)) for verb in S.VERBS}
    routes["rejected"] = requests.where(~good)
    return routes


def mm_key(requests: DataFrame, insert: bool = False) -> DataFrame:
    """Key text, chosen image and error of multimodal rows (text, imageRaw,
    imageUrl, multiType).

    Two images are an error. A query of kind IMG_TEXT needs an image, one of
    kind TEXT ignores it, other kinds are errors; an insert needs an image or a
    text.
    """
    present = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    url, raw = present("imageUrl"), present("imageRaw")
    key = F.array_join("text", S.ROLE_MARK)
    image = F.when(url, F.col("imageUrl")).when(raw, F.col("imageRaw"))
    both, neither = "both image forms given", "no image given"
    if insert:
        error = (F.when(url & raw, both)
                 .when(~url & ~raw & (key == ""), neither).otherwise(""))
    else:
        kind = F.coalesce(F.col("multiType"), F.lit(""))
        error = (F.when((kind == "IMG_TEXT") & url & raw, both)
                 .when((kind == "IMG_TEXT") & ~url & ~raw, neither)
                 .when(~kind.isin("IMG_TEXT", "TEXT"), "unknown multiType").otherwise(""))
        image = F.when(kind == "IMG_TEXT", image)
    return (requests.withColumn("key", key).withColumn("error_desc", error)
            .withColumn("image", F.when(F.col("error_desc") == "", image)))


def with_collection(rows: DataFrame, kind: str = "multiType") -> tuple:
    """(rows with stored kind and collection name, rejects of unknown kinds)."""
    from answerlake.functions.text import mm_collection
    mapped = rows.withColumn("mm_type", mm_type(F.col(kind))).withColumn(
        "collection", mm_collection(F.col("model"), F.col(kind)))
    known = F.col("mm_type").isNotNull()
    return mapped.where(known), mapped.where(~known)


def cache_enabled(rows: DataFrame, rule: Column = None) -> DataFrame:
    """Rows that use the cache; all by default."""
    return rows if rule is None else rows.where(rule)
