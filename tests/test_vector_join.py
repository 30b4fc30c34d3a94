"""Searches against brute force on small tables with copies, hot tenants, ties,
mixed dimensions and missing vectors."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerlake.operators import approx
from answerlake.operators import vector_join as vj
from answerlake.operators.range_join import range_join, semantic_dups

ENTRY = "id string, model string, embedding array<float>"
REQUEST = "request_id string, model string, embedding array<double>"


def data(seed=1, entries=400, requests=120, dim=12, copies=0.35):
    """Two thirds of everything in one tenant; a third of entries are copies."""
    rng = np.random.default_rng(seed)
    tenant = lambda n: np.where(rng.random(n) < 0.66, "hot", rng.choice(["b", "c"], n))
    vectors = rng.normal(size=(entries, dim)).astype(np.float32)
    same = rng.random(entries) < copies
    vectors[same] = vectors[0]
    e = [(f"e{i:04d}", str(t), v.tolist()) for i, (t, v) in enumerate(zip(tenant(entries), vectors))]
    asked = vectors[rng.integers(0, entries, requests)] + rng.normal(scale=0.2, size=(requests, dim))
    q = [(f"r{i:04d}", str(t), v.tolist()) for i, (t, v) in enumerate(zip(tenant(requests), asked))]
    return e, q


def brute(e, q, k, metric):
    out = set()
    for rid, tenant, v in q:
        v = np.array(v)
        scored = []
        for eid, t, w in e:
            if t == tenant and w is not None and len(w) == len(v):
                w = np.array(w, dtype=np.float64)
                cost = ((v - w) ** 2).sum() if metric == "l2" else -(v @ w) / np.linalg.norm(v) / np.linalg.norm(w)
                scored.append((round(cost, 9), eid))
        out |= {(rid, eid, n + 1) for n, (_, eid) in enumerate(sorted(scored)[:k])}
    return out


def found(df):
    return {(r.request_id, r.id, r.position) for r in df.collect()}


@pytest.mark.parametrize("method", ["scan", "tiles"])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("k", [1, 7])
def test_knn_is_exact(spark, method, metric, k):
    e, q = data()
    # copies of one vector have equal cosine up to rounding: compare costs there
    entries = spark.createDataFrame(e, ENTRY).repartition(5)
    got = found(vj.knn(spark.createDataFrame(q, REQUEST).repartition(3), entries, k, metric,
                       method=method, tile_rows=37))
    assert got == brute(e, q, k, metric)


@pytest.mark.parametrize("method", ["scan", "tiles"])
def test_knn_odd_rows(spark, method):
    e = [("a", "m", [1.0, 0.0]), ("b", "m", None), ("c", "m", [1.0, 0.0, 0.0]), ("d", "other", [1.0, 0.0])]
    q = [("r1", "m", [1.0, 0.1]), ("r2", "m", [0.0, 1.0, 0.0]), ("r3", "m", None), ("r4", "none", [1.0, 0.0])]
    df = vj.knn(spark.createDataFrame(q, REQUEST), spark.createDataFrame(e, ENTRY), 3, method=method)
    assert found(df) == {("r1", "a", 1), ("r2", "c", 1)}


def test_tiles_bound_a_hot_tenant(spark):
    """No tile of a hot tenant gets more than a few times the tile size."""
    e, q = data(entries=3000, requests=50)
    seen = spark.createDataFrame(e, ENTRY).groupBy("model").count().orderBy(F.desc("count")).first()
    assert seen["count"] > 1500
    df = vj.knn(spark.createDataFrame(q, REQUEST), spark.createDataFrame(e, ENTRY), 2,
                method="tiles", tile_rows=100)
    assert found(df) == brute(e, q, 2, "l2")


def test_two_nearest(spark):
    e, q = data(entries=60, requests=10)
    rows = vj.two_nearest(spark.createDataFrame(q, REQUEST), spark.createDataFrame(e, ENTRY)).collect()
    got = {(r.request_id, x["id"], n + 1) for r in rows for n, x in enumerate(r.found)}
    assert got == brute(e, q, 2, "l2")


@pytest.mark.parametrize("radius, reach", [(0.05, 1.0), (0.5, 1.0), (0.5, 0.0), (20.0, 0.5)])
def test_range_join_is_exact(spark, radius, reach):
    """By balls and by tiles, with tenants of two dimensions."""
    e, q = data(entries=200, requests=60)
    wide = lambda rows, n: [(f"w{i}", t, [*v, 0.25, float(len(i) % 2)]) for i, t, v in rows[:n]]
    e, q = e + wide(e, 70) + [("bad", "hot", None), ("nan", "hot", [float("nan")] * len(e[0][2]))], q + wide(q, 20)
    q.append(("r9999", "hot", q[0][2]))  # a repeated request vector
    got = {(r.request_id, r.id, r.copies) for r in range_join(
        spark.createDataFrame(q, REQUEST), spark.createDataFrame(e, ENTRY), radius,
        pivots=9, tile_rows=23, reach=reach).collect()}
    want = set()
    groups = {}
    for eid, t, v in e:
        if eid not in ("bad", "nan"):
            groups.setdefault((t, tuple(v)), []).append(eid)
    for rid, t, v in q:
        for (tenant, w), ids in groups.items():
            if tenant == t and len(v) == len(w) and ((np.array(v) - np.array(w, dtype=np.float64)) ** 2).sum() <= radius:
                want.add((rid, min(ids), len(ids)))
    assert got == want


@pytest.mark.parametrize("radius, reach", [(0.0, 1.0), (6.0, 1.0), (6.0, 0.0)])
def test_semantic_dups_is_exact(spark, radius, reach):
    e, _ = data(entries=150)
    got = {(r.id, r.duplicate_of) for r in semantic_dups(
        spark.createDataFrame(e, ENTRY), radius, pivots=7, tile_rows=19, reach=reach).collect()}
    want = set()
    for eid, t, v in e:
        near = [o for o, s, w in e if s == t and o < eid
                and ((np.array(v, dtype=np.float64) - np.array(w)) ** 2).sum() <= radius]
        if near:
            want.add((eid, min(near)))
    assert got == want


def recall(got, want):
    return len({(r, i) for r, i, _ in got} & {(r, i) for r, i, _ in want}) / len(want)


def test_ivf_recall(spark):
    e, q = data(entries=400, requests=100, copies=0.0)
    df = approx.knn_ivf(spark.createDataFrame(q, REQUEST), spark.createDataFrame(e, ENTRY), 1,
                        cells=16, probes=8)
    assert recall(found(df), brute(e, q, 1, "l2")) >= 0.9


def test_lsh_recall(spark):
    e, q = data(entries=400, requests=100, copies=0.0)
    df = approx.knn_lsh(spark.createDataFrame(q, REQUEST), spark.createDataFrame(e, ENTRY), 1,
                        bucket_length=4.0, tables=8)
    assert recall(found(df), brute(e, q, 1, "l2")) >= 0.8


def test_balls_prune_and_write_no_vectors(spark, monkeypatch):
    """Far apart clusters: few pairs are compared, and the tables written in between hold no cell copies."""
    from answerlake.operators import range_join as R

    r = np.random.default_rng(3)
    centers = r.normal(0, 100, (20, 6))
    rows = [(f"e{i}", "m", (centers[i % 20] + r.normal(0, 0.1, 6)).tolist()) for i in range(600)]
    written, counts = [], []
    cut, tiles = R.cut_lineage, R.tile_matches
    monkeypatch.setattr(R, "cut_lineage", lambda df, name: (written.append((name, df.columns)), cut(df, name))[1])
    monkeypatch.setattr(R, "tile_matches", lambda q, e, by, radius, **o: (counts.append(o["counts"]), tiles(q, e, by, radius, **o))[1])
    e = spark.createDataFrame(rows, ENTRY)
    got = {(x.id, x.duplicate_of) for x in semantic_dups(e, 0.05, tile_rows=100).collect()}
    v = {i: np.array(w) for i, _, w in rows}
    want = {(i, min(near)) for i in v if (near := [j for j in v if j < i and ((v[i] - v[j]) ** 2).sum() <= 0.05])}
    assert got == want
    assert {n for n, c in written if "_v" in c} == {"vectors", "pivots"}
    assert "_cell" in counts[0].columns
    assert counts[0].selectExpr("sum(_q_rows * _e_rows)").first()[0] <= 600 * 600 / 10


def test_small_tiles_do_not_copy_rows_with_the_square(spark):
    """Copies of a row are the tiles of the other side; they grow only once tiles are full."""
    rows = spark.createDataFrame([(n,) for n in (0, 1, 64, 300, 500, 25_000, 131_072, 10_000_000)], "n long")
    got = [tuple(r) for r in rows.select(vj.tile_count(F.col("n"), 64), vj.tile_count(F.col("n"), 16_384)).collect()]
    assert got == [(0, 0), (1, 1), (1, 1), (5, 1), (8, 1), (8, 2), (8, 8), (611, 611)]


def test_candidates_hold_the_smallest_of_every_row():
    """Also where all of them stand in one slice of the columns, and with ties."""
    r = np.random.default_rng(5)
    for cols in (3, 700, 1024, 1500, 4001):
        cost = r.integers(0, 40, (20, cols)).astype(np.float32)
        cost[0] = 7
        cost[1, ::256] -= 100
        for k in (1, 3, 20):
            at, col = vj._candidates(cost, k, 0.0)
            for i in range(len(cost)):
                found = np.sort(cost[i, col[at == i]])[:k]
                assert len(set(col[at == i])) == (at == i).sum() and list(found) == list(np.sort(cost[i])[:k])


def test_range_matches_are_repeated_only_for_hot_requests(spark, monkeypatch):
    """Matches of a vector that few requests have are not copied, and rows stay those of brute force."""
    from answerlake.operators import range_join as R
    copies = spark.createDataFrame([(n,) for n in (1, 1000, 1001, 10**9)], "n long")
    assert [r[0] for r in copies.select(R._salts(F.col("n"))).collect()] == [1, 1, 2, 64]
    monkeypatch.setattr(R, "SALT_ROWS", 3)
    e, q = data(seed=11, entries=60, requests=20)
    q += [(f"c{i:03d}", *q[i % 2][1:]) for i in range(30)]
    near = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w)) <= 4.0
    pairs = [(a, m) for a, m, v in q for _, t, w in e if t == m and near(v, w)]
    got = range_join(spark.createDataFrame(q, REQUEST), spark.createDataFrame(e, ENTRY), 4.0).collect()
    assert {(r.request_id, r.model) for r in got} == set(pairs) and sum(r.copies for r in got) == len(pairs)
    assert len({(r.request_id, r.id) for r in got}) == len(got)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_full_tile_holds_its_vectors_once(metric):
    """A task of knn_lsh, stream_lookup and rank_distance works on at most a full tile; beside its
    two matrices (16 MB) it needs little. Four tasks share an executor's memory for Python."""
    rng, n, dim = np.random.default_rng(3), vj.TILE_ROWS, 64
    stored = rng.normal(size=(n, dim)).astype(np.float32)
    asked = stored[rng.permutation(n)] + rng.normal(scale=0.1, size=(n, dim))
    lists = lambda m: pa.chunked_array([pa.array(list(part)) for part in np.array_split(m, 2)])
    ids = lambda c: pa.chunked_array([pa.array([f"{c}{i}" for i in range(n)])])
    left, right = (ids("r"), lists(asked)), (ids("e"), lists(stored))
    tracemalloc.start()
    (qids, eids, score), = vj._reduce(left, right, "nearest", (2, None), metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(qids) == len(eids) == len(score) == 2 * n
    assert peak < (40 if metric == "l2" else 56) << 20


def test_equal_rows_are_found_by_checked_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, size=(3000, 4)).astype(float)
    group, first = vj._groups_of_copies(m)
    assert len(first) == len(np.unique(m, axis=0)) and (m[first][group] == m).all()
    order = {tuple(r): i for i, r in reversed(list(enumerate(m.tolist())))}
    assert all(order[tuple(m[i])] == i for i in first)
    # rows of one hash that differ are still told apart
    unique = np.unique
    monkeypatch.setattr(vj.np, "unique", lambda a, **b: unique(a * 0 if a.dtype == np.uint64 else a, **b))
    group, first = vj._groups_of_copies(m)
    assert len(first) == 81 and (m[first][group] == m).all()
