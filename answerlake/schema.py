"""Table schemas and the fixed values of the cache protocol."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

CHAT = T.StructType([
    T.StructField("query", T.ArrayType(MESSAGE)),
    T.StructField("answer", T.StringType()),
])

SCOPE = T.StructType([T.StructField("model", T.StringType())])

REQUEST = T.StructType([
    T.StructField("requestId", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("scope", SCOPE),
    T.StructField("query", T.ArrayType(MESSAGE)),
    T.StructField("chat_info", T.ArrayType(CHAT)),
    T.StructField("remove_type", T.StringType()),
    T.StructField("id_list", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

MM_QUERY = T.StructType([
    T.StructField("text", T.ArrayType(T.StringType())),
    T.StructField("imageRaw", T.StringType()),
    T.StructField("imageUrl", T.StringType()),
    T.StructField("imageId", T.StringType()),
    T.StructField("multiType", T.StringType()),
])

MM_CHAT = T.StructType([
    T.StructField("query", MM_QUERY),
    T.StructField("answer", T.StringType()),
])

MM_REQUEST = T.StructType([
    T.StructField("UUID", T.StringType()),
    T.StructField("request_type", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("scope", SCOPE),
    T.StructField("query", MM_QUERY),
    T.StructField("chat_info", T.ArrayType(MM_CHAT)),
    T.StructField("remove_type", T.StringType()),
    T.StructField("id_list", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("mm_type", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("answer_type", T.IntegerType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("hit_count", T.LongType()),
    T.StructField("is_deleted", T.BooleanType()),
    T.StructField("gmt_create", T.TimestampNTZType()),
    T.StructField("gmt_modified", T.TimestampNTZType()),
])

QUERY_LOG = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("error_code", T.IntegerType()),
    T.StructField("error_desc", T.StringType()),
    T.StructField("cache_hit", T.BooleanType()),
    T.StructField("model", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("hit_query", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("delta_time", T.DoubleType()),
])

# Fixed values of the protocol: verbs, removal kinds, blocked tenants, answer
# types, key delimiters, length limits, image/text kinds, collection names,
# response codes, purge limits, sketch size and decay.
VERBS = ("query", "insert", "remove", "register")
REMOVE_TYPES = ("delete_by_id", "truncate_by_model")
BLACKLIST = ("DI_COPILOT_SECOND", "DI_COPILOT_LAB", "DI_COPILOT_THIRD")
ANSWER_TEXT, ANSWER_IMAGE_BASE64, ANSWER_IMAGE_URL = 0, 1, 2
ROLE_MARK, MESSAGE_MARK = "###", "|||"
SHORT_TEXT, SHORT_MM_TEXT = 256, 50
TOKEN_WINDOW = 510
MM_TYPES = {"IMG_TEXT": "mm", "mm": "mm", "IMG": "image", "image": "image",
            "TEXT": "text", "text": "text"}
MM_COLLECTION = "multi_cache_"
OK, BAD_TYPE, BAD_PARAMS, QUERY_BLOCKED, INSERT_BLOCKED = 0, 102, 103, 105, 305
QUERY_FAILED, QUERY_ERROR = 201, 202
INSERT_FAILED, INSERT_REJECTED, INSERT_ERROR = 301, 302, 303
BAD_REQUEST, REMOVE_INVALID, REMOVE_FAILED, REGISTER_FAILED = 400, 401, 402, 502
PURGE_MARKED, PURGE_RATE = 5000, 0.1
SKETCH_WIDTH, SKETCH_DEPTH, DECAY_EVERY = 1024, 4, 10000
