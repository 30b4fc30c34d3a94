"""Streams over several batches, restarts and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from answerlake.operators.maintain import new_entries
from answerlake.runtime import cut_lineage, scratch, shared_dir
from answerlake.streaming import jobs as J

LOG = "ts timestamp_ntz, model string, cache_hit boolean"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


def add(spark, path, rows, schema):
    """One more input file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_dropped(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    run = lambda: J.append_windows(J.hit_rate_windows(stream(spark, src, LOG)), out, ck).awaitTermination()
    add(spark, src, [(at(0, 5), "a", True), (at(0, 50), "a", False)], LOG)
    run()
    add(spark, src, [(at(3), "a", True)], LOG)
    run()
    add(spark, src, [(at(0, 30), "a", True), (at(2, 55), "a", True), (at(5), "a", True)], LOG)
    run()
    rows = {(r.window_start, r.queries, r.hits) for r in spark.read.parquet(out).collect()}
    assert rows == {(at(0), 2, 1), (at(2), 1, 1), (at(3), 1, 1)}


def test_sessions_close_after_the_gap(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "user_id long, ts timestamp_ntz"
    run = lambda: J.append_windows(J.session_windows(stream(spark, src, schema)), out, ck).awaitTermination()
    add(spark, src, [(1, at(0)), (1, at(0, 20)), (2, at(0, 5))], schema)
    run()
    add(spark, src, [(1, at(0, 45)), (1, at(2)), (2, at(4))], schema)
    run()
    rows = {(r.user_id, r.session_start, r.turns) for r in spark.read.parquet(out).collect()}
    assert rows == {(1, at(0), 3), (2, at(0, 5), 1), (1, at(2), 1)}


def test_running_hit_counts(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "hit_id string, cache_hit boolean"
    run = lambda: J.stream_hit_counts(stream(spark, src, schema), out, ck).awaitTermination()
    add(spark, src, [("a", True)] * 5 + [("b", True), ("a", False)], schema)
    run()
    add(spark, src, [("a", True), ("c", True)], schema)
    run()
    assert {(r.id, r.hit_count) for r in J.current_hit_counts(spark, out).collect()} == {
        ("a", 6), ("b", 1), ("c", 1)}


def test_requests_are_answered_once(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "request_id string, ts timestamp_ntz"
    run = lambda: J.stream_dedup_requests(stream(spark, src, schema), out, ck).awaitTermination()
    add(spark, src, [("r1", at(0)), ("r1", at(0, 1)), ("r2", at(0))], schema)
    run()
    add(spark, src, [("r1", at(0, 30)), ("r3", at(0, 30))], schema)
    run()
    assert sorted(r.request_id for r in spark.read.parquet(out).collect()) == ["r1", "r2", "r3"]


def test_insert_is_idempotent_over_batches(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "model string, question string, answer string"
    embed = lambda b: b.withColumn("embedding", F.array(F.lit(3.0), F.lit(4.0)))
    run = lambda: J.stream_insert(stream(spark, src, schema), out, ck, embed).awaitTermination()
    add(spark, src, [("m", "q1", "a1"), ("m", "q1", "a1"), ("m", "q2", "a2")], schema)
    run()
    add(spark, src, [("m", "q2", "a2"), ("m", "q1", "other"), ("n", "q1", "a1")], schema)
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.model, r.question, r.answer) for r in rows) == [
        ("m", "q1", "a1"), ("m", "q1", "other"), ("m", "q2", "a2"), ("n", "q1", "a1")]
    assert rows[0].embedding == pytest.approx([0.6, 0.8])


def test_lookup_sees_the_newest_snapshot(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "request_id string, model string, key string, embedding array<double>"
    table = {"rows": [("m", "q1", "a1", [1.0, 0.0])]}

    def entries():
        return new_entries(spark.createDataFrame(
            table["rows"], "model string, question string, answer string, embedding array<double>"))

    run = lambda: J.stream_lookup(stream(spark, src, schema), entries, out, ck).awaitTermination()
    add(spark, src, [("r1", "m", "k", [1.0, 0.0]), ("r2", "m", "k", [0.0, 1.0])], schema)
    run()
    table["rows"].append(("m", "q2", "a2", [0.0, 1.0]))
    add(spark, src, [("r3", "m", "k", [0.0, 1.0])], schema)
    run()
    got = {r.request_id: (r.cache_hit, r.answer) for r in spark.read.parquet(out).collect()}
    assert got == {"r1": (True, "a1"), "r2": (False, ""), "r3": (True, "a2")}


def test_scratch_folders_go(spark):
    import os

    with pytest.raises(ValueError), scratch(spark):
        kept = cut_lineage(spark.range(3), "scratch-test").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(kept)
        raise ValueError
    assert not os.path.exists(os.path.dirname(kept))
    assert cut_lineage(spark.range(3), "kept").count() == 3


def test_insert_checks_the_entry_table(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "model string, question string, answer string"
    embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    held = new_entries(embed(spark.createDataFrame([("m", "q", "a")], schema)))
    add(spark, src, [("m", "q", "a"), ("m", "q2", "a")], schema)
    J.stream_insert(stream(spark, src, schema), out, ck, embed, entries=lambda: held).awaitTermination()
    assert [r.question for r in spark.read.parquet(out).collect()] == ["q2"]


def test_insert_reads_no_earlier_output(spark):
    """Ids seen before are known by the state alone, over many batches and a restart."""
    from answerlake.runtime import remove_folder

    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "model string, question string, answer string"
    calls = []

    def embed(rows):
        calls.append(rows.count())
        return rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    run = lambda: J.stream_insert(stream(spark, src, schema), out, ck, embed).awaitTermination()
    for i in range(4):
        add(spark, src, [("m", "q0", "a"), (f"m{i % 2}", f"q{i}", "a"), (f"m{i % 2}", f"q{i}", "a")], schema)
    run()
    assert calls == [2, 1, 1, 1]  # only new rows are embedded
    rows = spark.read.parquet(out)
    assert sorted((r.model, r.question) for r in rows.collect()) == [
        ("m", "q0"), ("m0", "q0"), ("m0", "q2"), ("m1", "q1"), ("m1", "q3")]
    assert "/model=m1/" in "".join(rows.where("model = 'm1'").inputFiles())
    remove_folder(spark, out)
    add(spark, src, [("m", "q0", "a"), ("m", "new", "a")], schema)
    run()
    assert [r.question for r in spark.read.parquet(out).collect()] == ["new"]


def test_insert_that_forgets_asks_the_table(spark):
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "model string, question string, answer string, ts timestamp_ntz"
    embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    held = new_entries(embed(spark.createDataFrame([("m", "q", "a", at(0))], schema)))
    for hour in (0, 5, 10, 15):
        add(spark, src, [("m", "q", "a", at(hour)), ("m", f"q{hour}", "a", at(hour))], schema)
    J.stream_insert(stream(spark, src, schema), out, ck, embed, entries=lambda: held, within="1 hour").awaitTermination()
    assert sorted(r.question for r in spark.read.parquet(out).collect()) == ["q0", "q10", "q15", "q5"]


def test_hit_count_runs_are_merged(spark, monkeypatch):
    """Same counters at any time, few live runs, and a reader never misses a run."""
    monkeypatch.setattr(J, "RUNS", 3)
    src, out, ck = (shared_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "hit_id string, cache_hit boolean"
    want, n = {}, 0
    for batches in (5, 14, 10):
        for _ in range(batches):
            rows = [(f"e{(n * k) % 7}", True) for k in range(1, 4)] + [("miss", False)]
            add(spark, src, rows, schema)
            for e, hit in rows:
                if hit:
                    want[e] = want.get(e, 0) + 1
            n += 1
        J.stream_hit_counts(stream(spark, src, schema), out, ck).awaitTermination()
        assert {r.id: r.hit_count for r in J.current_hit_counts(spark, out).collect()} == want
        runs = J._runs(spark, out)
        live = sorted(r for r in runs if not J._covered(r, runs))
        assert live[0][0] == 0 and live[-1][1] == n - 1 and all(a[1] + 1 == b[0] for a, b in zip(live, live[1:]))
        assert len(live) <= 2 * 4 and len(runs) <= 16
    assert J.current_hit_counts(spark, shared_dir(spark, "none")).count() == 0
