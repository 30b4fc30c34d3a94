"""Token counts of whole texts through a digest cache.

A text's key is the SHA-256 of the text in normal form together with the digest of the
tokenizer file. The normal form joins words by single blanks, words being what ASCII
white space parts; the tokenizer drops white space and never joins over it, so equal
forms have equal counts. Keys are joined to a stored table of counts; the texts of missing
keys, one for each, are encoded, and their counts appended to the table before the result
is read from it.

Encoding adds up the counts of a text's words; words that a task has seen are looked up.
A single task therefore asks the library about each word once, as long as its cache holds.

Texts that over one in ``HOT`` of all rows share get their counts from a broadcast of fewer
than ``HOT`` rows, and blank texts need none, so the join's keys are spread evenly.

Cases: null and empty texts, and texts of white space, have no tokens; texts of any
length are encoded whole; repeated texts are encoded once and counted each; null ids are
carried; an empty table leaves the cache as it is. Extra columns are not read.
"""

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import col, per_text, table, utf8
from answerlake.runtime import cut_lineage, shared_dir

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
WORD_CACHE, ENCODE_BATCH, HOT = 150_000, 1_000, 10_000
CACHE_SCHEMA = "version binary, digest binary, n_tokens long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Token counts of texts, word by word."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = {}

    def learn(self, words) -> None:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > WORD_CACHE:
            known.clear()
            new = list(words)
        for k in range(0, len(new), ENCODE_BATCH):
            part = new[k:k + ENCODE_BATCH]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part],
                                                     add_special_tokens=False)
            known.update(zip(part, map(len, found)))

    def __call__(self, text: bytes) -> int:
        words = text.split()
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            different = set(words)
            if len(different) > WORD_CACHE // 2:  # one text with more words than the cache should hold
                return sum(self(b" ".join(words[k:k + WORD_CACHE // 2]))
                           for k in range(0, len(words), WORD_CACHE // 2))
            self.learn(different)
            return sum(map(self.known.__getitem__, words))


def normal_form(text: bytes) -> bytes:
    return b" ".join(text.split())


def _keys():
    def apply(texts):
        texts = [t or b"" for t in texts]
        forms = [normal_form(t) for t in texts]
        return {"n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "digest": pa.array([hashlib.sha256(f).digest() if f else None for f in forms], pa.binary())}
    return apply


def _different(held: int = 64 << 20):
    """Batches (text) to (digest, text), each digest once in a task as long as a set of
    digests of ``held`` bytes can tell."""
    def work(batches):
        seen = set()
        for batch in batches:
            digests, forms = [], []
            for text in utf8(batch.column(0)):
                form = normal_form(text or b"")
                if not form:
                    continue
                digest = hashlib.sha256(form).digest()
                if digest not in seen:
                    if len(seen) * 100 > held:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    forms.append(form)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(forms, pa.binary()).cast(pa.string())],
                names=["digest", "form"])
    return work


def _encode(vocabulary, version):
    """Batches (digest, form), equal digests in one task, to a count for each digest."""
    def work(batches):
        count, seen = Counter(vocabulary.value), set()
        for batch in batches:
            digests, counts = [], []
            for digest, form in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(count(form.as_py().encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.binary()), pa.array(digests, pa.binary()),
                 pa.array(counts, pa.int64())], names=["version", "digest", "n_tokens"])
    return work


def _hot(keyed: DataFrame) -> DataFrame:
    """Digests that over one in ``HOT`` of all rows have, so fewer than ``HOT`` of them."""
    total = keyed.count()
    return (keyed.where(F.col("own").isNotNull()).groupBy(F.col("own").alias("digest"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total).select("digest"))


def token_counts(docs: DataFrame, cache: str, key: str = "doc_id", text: str = "text",
                 vocabulary: str = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit. ``cache`` is the folder
    of the stored counts, made where there is none.
    """
    spark = docs.sparkSession
    with open(vocabulary or vocabulary_path(), "rb") as f:
        data = f.read()
    version, sent = hashlib.sha256(data).digest(), spark.sparkContext.broadcast(data)
    keyed = cut_lineage(per_text(docs, text, _keys, "n_bytes long, digest binary", {"doc_key": col(key)}), "keys")

    def stored():
        try:
            found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        except AnalysisException:
            return None
        return found.where(F.col("version") == F.lit(version)).select("digest", "n_tokens")

    # the texts of missing digests meet at the encoder, which takes one of each
    misses, known = docs.select(col(text).cast("string").alias("text")).mapInArrow(
        _different(), "digest binary, form string"), stored()
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    misses.repartition("digest").mapInArrow(_encode(sent, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts, keyed = stored(), keyed.withColumnRenamed("digest", "own")
    found = cut_lineage(counts.join(F.broadcast(_hot(keyed)), "digest", "left_semi")
                        .dropDuplicates(["digest"]), "hot-counts")
    once = keyed.join(F.broadcast(found), F.col("own") == F.col("digest"), "left").drop("digest")
    open_ = F.col("own").isNotNull() & F.col("n_tokens").isNull()
    rest = once.where(open_).drop("n_tokens").join(
        counts.dropDuplicates(["digest"]).withColumnRenamed("digest", "own"), "own", "left")
    return (once.where(~open_).unionByName(rest)
            .withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))
            .select(F.col("doc_key").alias(key), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))


@query("op2_token_counts")
def op2(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), shared_dir(spark, "token-counts"))
