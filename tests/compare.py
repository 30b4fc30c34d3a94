"""Run a registered query in Spark and its SQL in DuckDB, and compare all rows."""

import math
import os

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _type(t):
    if pa.types.is_large_string(t):
        return pa.string()
    return t


def _rows(table):
    table = table.select(sorted(table.column_names))
    rows = list(zip(*[c.to_pylist() for c in table.columns])) if table.num_columns else []
    return sorted(rows, key=repr)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9 * max(1, abs(a))
    return a == b


def compare(df, con, sql):
    """Number of rows when equal, else an AssertionError with the first difference."""
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    types = lambda t: {f.name: str(_type(f.type)) for f in t.schema}
    assert types(got) == types(want), f"schema {types(got)} != {types(want)}"
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b), f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        assert all(_same(p, q) for p, q in zip(x, y)), f"{x} != {y}"
    return len(a)
