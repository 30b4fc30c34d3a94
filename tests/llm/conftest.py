import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 997}x{i // 997}" for i in range(60_000)) + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("n", T.StringType()),
        T.StructField("doc", T.LongType()), T.StructField("carried", T.StringType()),
        T.StructField("node", T.StringType()), T.StructField("words.x", T.StringType()),
        T.StructField("given_0", T.StringType())])
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three."), (5, "one TWO three."), (6, "a"), (7, "A"),
             (8, LONG), (9, LONG), (9, LONG), (None, "One two three."), (None, None),
             (10, "The quick brown fox jumps over the lazy dog near the quiet river bank today."),
             (11, "!!! ### $$$ %%% &&& *** ||| <<< >>> ### $$$ %%%"), (12, "é" * 500 + " ﬁ 你好 \U0001f600 x.")]
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t or ""), "n", 7, "c", "d", "w", "g") for i, t in texts]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
