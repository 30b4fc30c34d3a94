"""Merge on read: deltas against the rewriting operators, plans, slices, conflicts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from answerlake.operators import maintain as M
from answerlake.runtime import shared_dir
from answerlake.sources import entry_table as E
from answerlake.sources.entry_table import EntryTable

AT = None


@pytest.fixture(autouse=True, scope="module")
def at_time(spark):
    global AT
    AT = F.expr("timestamp_ntz'2024-05-01 00:00:00'")


def entries(spark, n=300, start=0):
    rows = spark.range(start, start + n).select(
        F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.concat(F.lit("q"), "id").alias("question"),
        F.concat(F.lit("a"), "id").alias("answer"), F.concat(F.lit("e"), "id").alias("id"),
        F.array(F.col("id").cast("float"), F.lit(1.0)).alias("embedding"))
    return M.new_entries(rows, at=F.expr("timestamp_ntz'2024-01-01 00:00:00'"))


def ids(spark, *numbers):
    return spark.createDataFrame([(f"e{i}",) for i in numbers], "id string")


def rows(df):
    return sorted((r.id, r.model, r.question, tuple(r.embedding), r.hit_count, r.is_deleted, r.gmt_modified) for r in df.collect())


def answers(spark, *numbers):
    return spark.createDataFrame([(True, f"e{i}") for i in numbers] + [(False, None)], "cache_hit boolean, hit_id string")


@pytest.mark.parametrize("slice_bytes", [4200])
def test_deltas_equal_rewrites(spark, slice_bytes):
    """The table after each change, before and after compaction; also with a broadcast a bitmap."""
    want = entries(spark)
    table = EntryTable.create(spark, shared_dir(spark, "entries"), want.repartition(5), slice_bytes=slice_bytes)
    same = lambda: rows(table.read(deleted=True)) == rows(want)
    assert same()
    table.soft_delete(ids(spark, 1, 2, 2, 100, 999))
    want = M.soft_delete(want, ids(spark, 1, 2, 100))
    table.add_hits(answers(spark, 5, 5, 7, 299), AT)
    want = M.apply_hit_counts(want, answers(spark, 5, 5, 7, 299), AT)
    assert same()
    table.hard_delete(ids(spark, 7, 8, 100))
    want = M.hard_delete(want, ids(spark, 7, 8, 100))
    table.add_hits(answers(spark, 5, 9), AT)
    want = M.apply_hit_counts(want, answers(spark, 5, 9), AT)
    assert same() and rows(table.read()) == rows(want.where("NOT is_deleted"))
    new = entries(spark, 5, 298).select("id", "model", "question", "answer", "embedding").unionByName(
        entries(spark, 3, 1).select("id", "model", "question", "answer", "embedding"))
    table.insert(new, at=AT)
    want = M.insert_entries(want, new, at=AT)
    assert same()
    table.soft_delete(ids(spark, 1, 301, 40))
    want = M.soft_delete(want, ids(spark, 1, 301, 40))
    assert same()
    table.compact()
    assert same() and list(table.versions().values()) == ["f"]
    table.vacuum()
    assert same() and len(E.folder_names(spark, f"{table.path}/data")) == 1
    assert {r.model: r.purged for r in table.purge().collect()} == {
        r.model: r.purged for r in M.purge_deleted(want)[1].collect()}
    want = M.purge_deleted(want)[0]
    assert same() and table.purge().isEmpty()
    table.truncate(["m1"])
    want = want.where("model <> 'm1'")
    assert same() and rows(table.read(models=["m2"])) == rows(want.where("model = 'm2'"))
    assert rows(table.read(counters=False).drop("hit_count").withColumn("hit_count", F.lit(0))) == rows(
        want.withColumn("hit_count", F.lit(0)).withColumn("gmt_modified", F.col("gmt_modified")))


def exchanged(df):
    """Columns that cross an exchange in the plan."""
    plan, found = df._jdf.queryExecution().executedPlan(), ""

    def walk(node):
        nonlocal found
        if "Exchange" in node.nodeName():
            found += " " + node.output().mkString(" ")
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.inputPlan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
    walk(plan)
    return found


def test_changes_shuffle_no_text_or_vector(spark, monkeypatch):
    table = EntryTable.create(spark, shared_dir(spark, "entries"), entries(spark))
    table.soft_delete(ids(spark, 3))
    table.add_hits(answers(spark, 4), AT)
    seen = []
    commit = EntryTable._commit
    monkeypatch.setattr(EntryTable, "_commit", lambda self, version, data=None, marks=None, hits=None, full=False: (
        seen.extend(x for x in (marks, hits) if x is not None), commit(self, version, data, marks, hits, full))[1])
    table.soft_delete(ids(spark, 5))
    table.hard_delete(ids(spark, 6))
    table.add_hits(answers(spark, 4, 9), AT)
    table.purge()
    assert len(seen) == 4
    for frame in [*seen, table.read(deleted=True)]:
        crossing = exchanged(frame)
        assert not any(name in crossing for name in ("embedding", "question", "answer")), crossing
    for frame in seen:  # and read none
        scans = frame._jdf.queryExecution().toString()
        assert "embedding:" not in scans.split("== Physical Plan ==")[1]


def test_second_writer_of_a_version_fails(spark):
    path = shared_dir(spark, "entries")
    one, other = EntryTable.create(spark, path, entries(spark, 20)), EntryTable(spark, path)
    version = other._next()
    one.soft_delete(ids(spark, 1))
    with pytest.raises(E.Conflict):
        other._commit(version, marks=E._bitmaps(other.located().select("model", "part", "pos"), True))
    assert other.read(deleted=True).count() == 20 and other.read().count() == 19
    other.hard_delete(ids(spark, 2))  # again, on the new version
    one.compact()
    one.vacuum()
    assert one.read(deleted=True).count() == 19 and E.folder_names(spark, f"{path}/marks") == []


def test_batch_is_one_version(spark):
    table = EntryTable.create(spark, shared_dir(spark, "entries"), entries(spark, 30))
    before = len(table.versions())
    removes = spark.createDataFrame([("m0", "truncate_by_model", None), ("m1", "delete_by_id", ["e1", "e4", "e2"])],
                                    "model string, remove_type string, id_list array<string>")
    inserts = spark.createDataFrame([("m1", "q1", "a1", "e1", [1.0, 1.0]), ("m1", "q5", "a5", "e50", [3.0, 4.0])],
                                    "model string, question string, answer string, id string, embedding array<double>")
    table.apply({"hits": answers(spark, 7, 7), "removes": removes, "inserts": inserts}, AT)
    assert len(table.versions()) == before + 1
    got = {r.id: r for r in table.read(deleted=True).collect()}
    assert {r.model for r in got.values()} == {"m1", "m2"} and got["e7"].hit_count == 2
    assert got["e4"].is_deleted and not got["e1"].is_deleted and not got["e2"].is_deleted and "e50" in got
    assert got["e1"].gmt_create == dt.datetime(2024, 5, 1) and len(got) == 21


def test_empty_table_and_null_ids(spark):
    table = EntryTable.create(spark, shared_dir(spark, "entries"), entries(spark, 0))
    assert table.read().count() == 0 and table.purge().isEmpty()
    table.soft_delete(spark.createDataFrame([(None,)], "id string"))
    table.insert(entries(spark, 4).drop("hit_count"), at=AT)
    table.compact()
    assert table.read().count() == 4
