"""Operators for building training data from a corpus, with their queries."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a query (spark, sf_dir) -> DataFrame, with its SQL if there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load():
    from answerlake.llm import collocations, decontaminate, jaccard_join, language, licenses, main_text, mixing, quality  # noqa: F401
    from answerlake.llm import simhash, token_counts, token_shards, warc, whitening  # noqa: F401
    return QUERIES, ORACLES
