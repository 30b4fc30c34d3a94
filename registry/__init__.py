"""Registered queries, each next to the SQL that must give the same rows."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load():
    from registry import (analytics, deltas, embedding, evaluation, lifecycle, maintenance,  # noqa: F401
                          retention, search, shaping, sources, streams)
    return QUERIES, ORACLES
