"""Object payloads and image files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake import schema as S


def externalize_objects(entries: DataFrame) -> tuple:
    """(entries, objects): answers that are not plain text move to an object
    table under their content hash, and the entry keeps the hash."""
    is_object = F.col("answer_type") != S.ANSWER_TEXT
    key = F.sha2(F.col("answer"), 256)
    objects = (entries.where(is_object & F.col("answer").isNotNull())
               .select(key.alias("object_key"), F.col("answer").alias("payload"))
               .dropDuplicates(["object_key"]))
    slim = entries.withColumn("answer", F.when(is_object, key).otherwise(F.col("answer")))
    return slim, objects


def get_objects(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Entries with their payload put back. Only entries that have an object are joined."""
    is_object = F.coalesce((F.col("answer_type") != S.ANSWER_TEXT) & F.col("answer").isNotNull(), F.lit(False))
    rest = [c for c in entries.columns if c != "answer"]
    filled = (entries.where(is_object).withColumnRenamed("answer", "object_key")
              .join(objects, "object_key", "left").select(*rest, F.col("payload").alias("answer")))
    return entries.where(~is_object).select(*rest, "answer").unionByName(filled)


def delete_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    return objects.join(keys.select("object_key"), "object_key", "left_anti")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as rows of path, name and bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                        F.col("length"), F.col("content"))


def image_question_key(questions: DataFrame, images: DataFrame) -> DataFrame:
    """Key of an image question: the image bytes as text, then the question."""
    return questions.join(images.select("name", "content"), "name").withColumn(
        "key", F.concat(F.base64("content"), F.col("question"))).drop("content")
