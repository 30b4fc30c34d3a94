"""The entry table that merges its changes when it is read."""

from pyspark.sql import functions as F

from answerlake.runtime import shared_dir
from answerlake.sources.entry_table import EntryTable
from registry import query
from registry import tables as t
from registry.maintenance import _GONE, _SQL_AT, FRESH, at, fresh_rows, responses, to_remove

_COLUMNS = ["id", "model", "question", "answer", "hit_count", "is_deleted", "gmt_modified"]


def changed(spark, sf):
    """Every entry, then a soft delete, hits, new rows and a hard delete as deltas."""
    table = EntryTable.create(spark, shared_dir(spark, "entry-table"), t.entries(spark, sf))
    table.soft_delete(to_remove(spark, sf))
    table.add_hits(responses(spark, sf), at())
    table.insert(fresh_rows(spark, sf).drop("ref"), at=at())
    table.hard_delete(t.entries(spark, sf).where("label = 7").select("id"))
    return table


_CHANGED = f"""WITH {FRESH}, {t.ENTRIES}, {t.LOG},
hits AS (SELECT substr(answer, 2) AS id, count(*) AS n FROM query_log WHERE cache_hit GROUP BY ALL),
changed AS (SELECT e.id, model, question, answer, (hit_count + coalesce(n, 0))::BIGINT AS hit_count,
    is_deleted OR e.{_GONE} AS is_deleted, CASE WHEN n IS NULL THEN gmt_modified ELSE {_SQL_AT} END AS gmt_modified, embedding
  FROM entries e LEFT JOIN hits h ON e.id = h.id WHERE label <> 7
  UNION ALL SELECT id, model, question, answer, 0, false, {_SQL_AT}, embedding FROM fresh)
"""


def _rows(df):
    return df.select(*_COLUMNS, *t.vector_digest())


@query("entry_table_deltas", f"{_CHANGED} SELECT {', '.join(_COLUMNS)}, {t.sql_digest()} FROM changed")
def entry_table_deltas(spark, sf):
    return _rows(changed(spark, sf).read(deleted=True))


@query("entry_table_purged", f"{_CHANGED} SELECT {', '.join(_COLUMNS)}, {t.sql_digest()} FROM changed WHERE NOT is_deleted")
def entry_table_purged(spark, sf):
    table = changed(spark, sf)
    table.purge()
    return _rows(table.read(deleted=True))


@query("entry_table_compacted", f"{_CHANGED} SELECT {', '.join(_COLUMNS)}, {t.sql_digest()} FROM changed")
def entry_table_compacted(spark, sf):
    table = changed(spark, sf)
    table.compact()
    table.vacuum()
    return _rows(table.read(deleted=True))


@query("entry_table_purge_counts", f"{_CHANGED} SELECT model, count(*) AS purged FROM changed WHERE is_deleted GROUP BY model")
def entry_table_purge_counts(spark, sf):
    return changed(spark, sf).purge().select("model", F.col("purged").cast("long").alias("purged"))
