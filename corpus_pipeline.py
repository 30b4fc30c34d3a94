"""From raw documents to training shards: five stages, each a table for the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. SQL cannot express the stages with models and tokens, so there
is no SQL; the tests hold them against brute force.
"""

from pyspark.sql import DataFrame, SparkSession

from answerlake.llm.common import table
from answerlake.llm.decontaminate import remove_benchmark
from answerlake.llm.jaccard_join import one_of_each
from answerlake.llm.mixing import TARGETS, domain_labels, mixed_documents
from answerlake.llm.quality import clean_documents
from answerlake.llm.token_shards import materialise
from answerlake.runtime import cut_lineage, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without failing lines; rejected documents go."""
    return clean_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 or more of five-word shingles."""
    return one_of_each(docs, width=5, threshold=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages; documents that are mostly benchmark go."""
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fewer toxic and low documents, to their target weights; none is repeated."""
    return mixed_documents(docs, domain_labels(table(spark, sf_dir, "labels")), TARGETS, "good")


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; a row for each piece of a document."""
    return materialise(docs, shared_dir(spark, "pipeline-shards"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_weights", mixing_weights),
    ("token_shards", token_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
