"""Retention against naive replays and the invariants of a bounded cache."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerlake.operators import retain as R
from answerlake.runtime import number_rows, top_n

LOG = "model string, key string, op string, seq long"


def accesses(seed=3, n=3000, keys=300):
    """One tenant and one key hold much of the log."""
    rng = np.random.default_rng(seed)
    model = np.where(rng.random(n) < 0.7, "hot", "b")
    key = np.where(rng.random(n) < 0.33, "k0", [f"k{i}" for i in rng.integers(0, keys, n)])
    op = np.where(rng.random(n) < 0.4, "put", "get")
    return [(str(m), str(k), str(o), int(s)) for m, k, o, s in zip(model, key, op, rng.permutation(n))]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(accesses(), LOG).cache()


POLICIES = {
    "lru": lambda log, n: R.retain_lru(log, n),
    "fifo": lambda log, n: R.retain_fifo(log, n),
    "lfu": lambda log, n: R.retain_lfu(log, n),
    "random": lambda log, n: R.retain_random(log, n, 5),
    "segmented": lambda log, n: R.retain_segmented(log, n, every=100),
}


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("n", [1, 7, 120, 5000])
def test_size_bound(log, policy, n):
    kept = POLICIES[policy](log, n)
    assert kept.groupBy("model").count().where(F.col("count") > n).count() == 0
    assert kept.count() == kept.select("model", "key").distinct().count()


@pytest.mark.parametrize("policy", ["lfu", "segmented"])
def test_frequent_key_survives(log, policy):
    kept = POLICIES[policy](log, 20).where("key = 'k0'")
    assert kept.count() == 2


@pytest.mark.parametrize("n, target", [(10, 0), (10, 4), (50, 50), (400, 100)])
def test_two_lists(log, n, target):
    rows = R.retain_recency_frequency(log, n, target).collect()
    keys = {}
    for m, k, op, s in accesses():
        keys.setdefault(m, {}).setdefault(k, []).append(s)
    for m, ks in keys.items():
        once = sorted((k for k in ks if len(ks[k]) == 1), key=lambda k: -max(ks[k]))
        more = sorted((k for k in ks if len(ks[k]) > 1), key=lambda k: -max(ks[k]))
        keep2 = min(len(more), n - min(len(once), target))
        keep1 = min(len(once), n - keep2)
        want = ({(k, "t1") for k in once[:keep1]} | {(k, "b1") for k in once[keep1:keep1 + n - target]}
                | {(k, "t2") for k in more[:keep2]} | {(k, "b2") for k in more[keep2:keep2 + target]})
        assert {(r.key, r.segment) for r in rows if r.model == m} == want


def test_window_segment_is_at_least_one():
    assert R.segment_sizes(3) == (1, 1, 1)
    assert R.segment_sizes(100, 0.4) == (40, 30, 30)
    with pytest.raises(ValueError):
        R.segment_sizes(10, 50)


def naive_frequency(rows, every):
    out = {}
    for model in {r[0] for r in rows}:
        counts, n = {}, 0
        for _, key, op, _ in sorted((r for r in rows if r[0] == model), key=lambda r: r[3]):
            if op == "put":
                counts[key] = counts.get(key, 0) + 1
                n += 1
                if n % every == 0:
                    counts = {k: c >> 1 for k, c in counts.items()}
        out.update({(model, k): c for k, c in counts.items()})
    return out


@pytest.mark.parametrize("every", [1, 3, 10, 97, 10_000])
def test_decayed_frequency(log, every):
    got = {(r.model, r.key): r.frequency for r in R.decayed_frequency(log, every).collect()}
    assert got == naive_frequency(accesses(), every)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from(["put", "get"])),
                min_size=1, max_size=120), st.integers(1, 4))
def test_decay_of_any_log(spark, rows, every):
    rows = [(*r, i) for i, r in enumerate(rows)]
    got = {(r.model, r.key): r.frequency
           for r in R.decayed_frequency(spark.createDataFrame(rows, LOG), every).collect()}
    assert got == naive_frequency(rows, every)


def test_decay_never_raises_an_estimate(log):
    plain = {(r.model, r.key): r.frequency for r in R.decayed_frequency(log, 10**6).collect()}
    for r in R.decayed_frequency(log, 50).collect():
        assert r.frequency <= plain[r.model, r.key]


def test_sketch_never_undercounts(log):
    puts = {(r.model, r.key): r["count"] for r in
            log.where("op = 'put'").groupBy("model", "key").count().collect()}
    small = R.freq_sketch(log, width=64)
    for r in R.sketch_estimates(log, small, width=64).collect():
        assert r.estimate >= puts.get((r.model, r.key), 0)


def naive_segments(rows, n, every):
    freq = naive_frequency(rows, every)
    window, probation, protected = R.segment_sizes(n)
    out = set()
    for model in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == model]
        stats = {}
        for _, k, op, s in mine:
            g, last, put = stats.get(k, (0, -1, -1))
            stats[k] = (g + (op == "get"), max(last, s), max(put, s) if op == "put" else put)
        left = dict(stats)
        first = sorted((k for k in left if left[k][2] >= 0), key=lambda k: -left[k][2])[:window]
        order = lambda k: (-freq.get((model, k), 0), -left[k][1])
        for k in first:
            left.pop(k)
        second = sorted((k for k in left if left[k][0] > 0), key=order)[:protected]
        for k in second:
            left.pop(k)
        third = sorted(left, key=order)[:probation]
        out |= ({(model, k, "window") for k in first} | {(model, k, "protected") for k in second}
                | {(model, k, "probation") for k in third})
    return out


@pytest.mark.parametrize("n", [1, 5, 40, 200])
def test_segments(log, n):
    got = {(r.model, r.key, r.segment) for r in R.retain_segmented(log, n, every=100).collect()}
    assert got == naive_segments(accesses(), n, 100)


def test_number_rows(log):
    got = {(r.model, r.seq): (r.place, r.total) for r in
           number_rows(log, ["model"], "seq", "place", "total", width=16).collect()}
    for model in ("hot", "b"):
        seqs = sorted(r[3] for r in accesses() if r[0] == model)
        assert all(got[model, s] == (i + 1, len(seqs)) for i, s in enumerate(seqs))


def test_top_n(spark):
    df = spark.range(1000).selectExpr("id % 2 as g", "id", "id % 7 as v")
    got = [(r.g, r.id) for r in top_n(df, ["g"], [F.desc("v"), F.asc("id")], 5, ["id"])
           .orderBy("g", "position").collect()]
    want = []
    for g in (0, 1):
        want += [(g, i) for i in sorted((i for i in range(1000) if i % 2 == g), key=lambda i: (-(i % 7), i))[:5]]
    assert got == want
