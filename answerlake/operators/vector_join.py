"""Exact vector joins inside a tenant.

Two physical forms, one result:

* ``scan``: a request batch proven small is broadcast and the entry table is
  read in place, each task keeping its own best candidates. No entry moves.
* ``tiles``: both sides are hashed to tiles of about ``tile_rows`` rows (more where that would
  be over ``MOST_TILES`` small tiles, as rows are copied to each), so a
  tenant of any size is spread over (its request tiles x its entry tiles) tasks.
  A task multiplies two bounded matrices and returns only the reduced result,
  never its pairs.

Reducers: the ``k`` nearest, every match within a radius, or the first match
with a smaller id.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.runtime import broadcast_if_small

TILE_ROWS = 16_384
SCAN_REQUESTS = 10_000
SCAN_BYTES = 64 << 20
MOST_TILES = 8
CHUNK, COST_CELLS = 256, 1 << 20
SLICES = 256
PAIR_CELLS, ROW_SLICE = 1 << 19, 1024


# --- matrix helpers used inside tasks -------------------------------------

def _by_dim(ids, vectors, by_id=False):
    """{dimension: (ids, float64 matrix)}, with ``by_id`` in order of ids; null vectors and vectors with
    an element that is null, NaN or infinite are left out, as they are near to nothing. Chunks are
    written straight to the matrix, so that no second copy of the vectors is held."""
    chunks = vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    sizes = [np.asarray(pc.fill_null(pc.list_value_length(c), 0)) for c in chunks]
    out = {}
    for dim in np.unique(np.concatenate([np.empty(0, int), *sizes])).tolist():
        if dim:
            masks = [n == dim for n in sizes]
            own = ids.filter(pa.array(np.concatenate(masks))).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable") if by_id else np.arange(len(own))
            place = np.empty(len(own), int)
            place[order] = np.arange(len(own))
            matrix, at = np.empty((len(own), dim)), 0
            for chunk, mask in zip(chunks, masks):
                if mask.any():
                    flat = pc.list_flatten(chunk if mask.all() else chunk.filter(pa.array(mask)))
                    rows = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
                    matrix[place[at:at + len(rows)]] = rows
                    at += len(rows)
            good = np.isfinite(matrix).all(axis=1)
            if good.all():
                out[dim] = (own[order], matrix)
            elif good.any():
                out[dim] = (own[order][good], matrix[good])
    return out


def _prepare(m, metric):
    if metric == "cosine":
        out = np.empty_like(m)
        for at in range(0, len(m), ROW_SLICE):
            part = m[at:at + ROW_SLICE]
            size = np.linalg.norm(part, axis=1, keepdims=True)
            out[at:at + ROW_SLICE] = part / np.where(size > 0, size, 1.0)
        return out
    return m


def _squares(m):
    """Squared length of each row."""
    out = np.empty(len(m))
    for at in range(0, len(m), ROW_SLICE):
        part = m[at:at + ROW_SLICE]
        out[at:at + ROW_SLICE] = (part * part).sum(1)
    return out


def _blocks(q, e):
    """First row and rows of the request blocks whose costs against ``e`` are held at once."""
    step = max(16, min(CHUNK, COST_CELLS // max(1, len(e))))
    for at in range(0, len(q), step):
        yield at, q[at:at + step]


class _Costs:
    """Approximate costs against fixed entries by one single-precision matrix product, with
    a bound of their error. Squared distances lack the request's own norm, which does not
    change their order. Callers settle everything within the bound exactly."""

    def __init__(self, e, metric):
        self.e, self.metric, self.ee, self.right = e, metric, _squares(e), {}

    def __call__(self, q):
        scale = (q * q).sum(1).max(initial=0) + self.ee.max(initial=0)
        kind = np.float32 if 1e-30 < scale < 1e30 else np.float64
        tol = np.finfo(kind).eps * (q.shape[1] + 16) * scale
        if kind not in self.right:
            dim = self.e.shape[1]
            wide = np.empty((len(self.e), dim if self.metric == "cosine" else dim + 1), kind)
            wide[:, :dim] = self.e
            if self.metric != "cosine":
                wide[:, dim] = self.ee
            self.right[kind] = wide.T
        left = -q if self.metric == "cosine" else np.hstack([-2 * q, np.ones((len(q), 1))])
        return left.astype(kind) @ self.right[kind], tol


def _pairs(mask):
    """Row and column of the set cells."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _exact(q, e, qi, ei, metric):
    """Exact costs of the given pairs, in bounded slices."""
    out = np.empty(len(qi))
    step = max(1, PAIR_CELLS // max(1, q.shape[1]))
    for at in range(0, len(qi), step):
        a, b = q[qi[at:at + step]], e[ei[at:at + step]]
        part = -np.einsum("ij,ij->i", a, b) if metric == "cosine" else ((a - b) ** 2).sum(1)
        out[at:at + step] = part
    return out


def _groups_of_copies(m):
    """For each row the number of its group of equal rows, and the first rows. Rows are told
    apart by a hash, which is checked against the rows."""
    bits = np.ascontiguousarray(m, dtype=np.float64).view(np.uint64)
    code = np.zeros(len(bits), np.uint64)
    for c in range(bits.shape[1]):
        code = (code ^ bits[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    group = group.ravel()
    later = np.flatnonzero(first[group] != np.arange(len(bits)))
    for at in range(0, len(later), ROW_SLICE):
        rows = later[at:at + ROW_SLICE]
        if not np.array_equal(bits[rows], bits[first[group[rows]]]):
            whole = bits.view(np.dtype((np.void, 8 * bits.shape[1]))).ravel()
            _, first, group = np.unique(whole, return_index=True, return_inverse=True)
            return group.ravel(), first
    return group, first


def _first_copies(m, k):
    """Rows of ``m`` without those that ``k`` equal rows precede: no request can
    have them among its ``k`` nearest."""
    group, first = _groups_of_copies(m)
    if len(first) == len(m):
        return np.arange(len(m))
    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], np.arange(len(first)))
    place = np.empty(len(m), int)
    place[order] = np.arange(len(m)) - start[group[order]]
    return np.flatnonzero(place < k)


def _candidates(cost, k, tol):
    """Row and column of every cell that may be one of the ``k`` smallest of its row. The columns
    are put to strided slices: the k-th smallest of the slices' minima bounds the k-th smallest
    cost, and only slices with a minimum within the bound are looked at again."""
    cols, n = cost.shape[1], max(SLICES, 16 * k)
    width = cols // n
    if width < 4:
        cut = np.partition(cost, k - 1, axis=1)[:, k - 1:k] + 2 * tol if k < cols else np.inf
        return _pairs(cost <= cut)
    least = cost[:, :width * n].reshape(len(cost), width, n).min(axis=1)
    rest = cost[:, width * n:]
    np.minimum(least[:, :rest.shape[1]], rest, out=least[:, :rest.shape[1]])
    cut = np.partition(least, k - 1, axis=1)[:, k - 1:k] + 2 * tol
    qi, ei = _pairs(least <= cut)
    at = ei[:, None] + n * np.arange(width + 1)
    hit = (at < cols) & (cost[qi[:, None], np.minimum(at, cols - 1)] <= cut[qi])
    row, place = np.nonzero(hit)
    return qi[row], at[row, place]


def _nearest(q, e, k, metric):
    """(request row, entry row, cost) of the k best, ties by entry row; every
    request row has min(k, entries) results."""
    kept = _first_copies(e, k)
    e = e if len(kept) == len(e) else e[kept]
    costs, parts = _Costs(e, metric), []
    for at, block in _blocks(q, e):
        cost, tol = costs(block)
        qi, ei = _candidates(cost, k, tol)
        exact = _exact(block, e, qi, ei, metric)
        order = np.lexsort((ei, exact, qi))
        qi, ei, exact = qi[order], ei[order], exact[order]
        first = np.searchsorted(qi, np.arange(len(block)))
        keep = np.arange(len(qi)) - first[qi] < k
        parts.append((qi[keep] + at, kept[ei[keep]], exact[keep]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _matches(q, e, radius, metric):
    """Per request block: the matrix of exact ``cost <= radius`` decisions."""
    costs = _Costs(e, metric)
    for at, block in _blocks(q, e):
        cost, tol = costs(block)
        if metric == "l2":
            cost = cost + (block * block).sum(1)[:, None]
        hit = cost <= radius - tol
        qi, ei = _pairs(np.abs(cost - radius) <= tol)
        if len(qi):
            hit[qi, ei] = _exact(block, e, qi, ei, metric) <= radius
        yield at, block, hit


def _within(q, e, radius, metric):
    costs, parts = _Costs(e, metric), []
    for at, block in _blocks(q, e):
        cost, tol = costs(block)
        limit = radius + tol - ((block * block).sum(1) if metric == "l2" else np.zeros(len(block)))
        limit = np.nextafter(limit.astype(cost.dtype), cost.dtype.type(np.inf))
        qi, ei = _pairs(cost <= limit[:, None])
        exact = _exact(block, e, qi, ei, metric)
        good = exact <= radius
        parts.append((qi[good] + at, ei[good], exact[good]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _first_smaller(q, e, qids, eids, radius, metric):
    """For each request row the first entry row within the radius whose id is
    smaller than the request's; entries are sorted by id."""
    below = np.searchsorted(eids, qids)
    parts = []
    for at, block, hit in _matches(q, e, radius, metric):
        hit &= np.arange(hit.shape[1])[None, :] < below[at:at + len(block), None]
        qi = np.nonzero(hit.any(axis=1))[0]
        ei = hit[qi].argmax(axis=1)
        parts.append((qi + at, ei, _exact(block, e, qi, ei, metric)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _reduce(left, right, reducer, arg, metric):
    """(request ids, entry ids, score) of one tile, a part per dimension."""
    qs, es = _by_dim(*left), _by_dim(*right, by_id=True)
    out = []
    for dim in sorted(set(qs) & set(es)):
        (qids, q), (eids, e) = qs[dim], es[dim]
        if reducer == "nearest":
            k, max_cost = arg
            best = _Best(qids, q, k, metric)
            best.add(eids, e)
            out.append(best.result(max_cost))
            continue
        q, e = _prepare(q, metric), _prepare(e, metric)
        if reducer == "within":
            qi, ei, cost = _within(q, e, arg, metric)
        else:
            qi, ei, cost = _first_smaller(q, e, qids, eids, arg, metric)
        out.append((qids[qi], eids[ei], -cost if metric == "cosine" else cost))
    return out


class _Best:
    """The ``k`` best entries so far of a fixed set of requests; equal request
    vectors are searched once."""

    def __init__(self, ids, matrix, k, metric):
        self.group, first = _groups_of_copies(matrix)
        if len(first) == len(matrix):
            self.group = first = np.arange(len(matrix))
        else:
            matrix = matrix[first]
        self.ids, self.q, self.k, self.metric = ids, _prepare(matrix, metric), k, metric
        self.entries = np.empty((len(first), 0), object)
        self.cost = np.empty((len(first), 0))

    def add(self, eids, e):
        """Entries in order of ids."""
        _, ei, cost = _nearest(self.q, _prepare(e, self.metric), self.k, self.metric)
        shape = (len(self.q), -1)
        entries = np.hstack([self.entries, eids[ei].astype(object).reshape(shape)])
        cost = np.hstack([self.cost, cost.reshape(shape)])
        ranks = np.unique(entries, return_inverse=True)[1].reshape(entries.shape)
        order = np.lexsort((ranks, cost), axis=1)[:, :self.k]
        self.entries = np.take_along_axis(entries, order, axis=1)
        self.cost = np.take_along_axis(cost, order, axis=1)

    def result(self, max_cost=None):
        """(request ids, entry ids, score), flat."""
        entries, cost = self.entries[self.group], self.cost[self.group]
        ids, entries, cost = np.repeat(self.ids, cost.shape[1]), entries.ravel(), cost.ravel()
        if max_cost is not None:
            good = cost <= max_cost + 1e-9
            ids, entries, cost = ids[good], entries[good], cost[good]
        return ids, entries, -cost if self.metric == "cosine" else cost


# --- physical forms ---------------------------------------------------------

def _side(df, by, id_col, vec_col, new_id):
    return df.select(*by, F.col(id_col).alias(new_id), F.col(vec_col).alias("_v"))


def _result_schema(df, by, q_type, e_type):
    return T.StructType([*(df.schema[c] for c in by), T.StructField("_q", q_type),
                         T.StructField("_e", e_type), T.StructField("score", T.DoubleType())])


def tile_count(rows: Column, tile_rows: int) -> Column:
    """Tiles of a side. A row is copied to every tile of the other side, so small ``tile_rows``
    give at most ``MOST_TILES``: then tiles get more rows, and more in number once they are full."""
    of = lambda size: F.ceil(rows / F.lit(size))
    return F.least(of(tile_rows), F.greatest(F.lit(MOST_TILES), of(max(TILE_ROWS, tile_rows)))).cast("int")


def _tile_join(q: DataFrame, e: DataFrame, by: list, reducer: str, arg, metric: str,
               tile_rows: int, counts: DataFrame = None) -> DataFrame:
    """``counts`` has the rows of both sides, (by..., _q_rows, _e_rows), where the caller knows them."""
    if counts is None:
        rows = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
        counts = rows(q, "_q_rows").join(rows(e, "_e_rows"), by)
    counts = broadcast_if_small(counts.select(*by, tile_count(F.col("_q_rows"), tile_rows).alias("_nq"),
                                              tile_count(F.col("_e_rows"), tile_rows).alias("_ne")))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    repeat = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (q.join(counts, by).withColumn("_qt", spread("_q", "_nq"))
            .withColumn("_et", repeat("_ne")).drop("_nq", "_ne"))
    right = (e.join(counts, by).withColumn("_et", spread("_e", "_ne"))
             .withColumn("_qt", repeat("_nq")).drop("_nq", "_ne"))
    keys = [*by, "_qt", "_et"]
    schema = _result_schema(e, by, q.schema["_q"].dataType, e.schema["_e"].dataType)
    fields = [(f.name, f.dataType) for f in schema]

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type
        names = [n for n, _ in fields]
        types = [to_arrow_type(t) for _, t in fields]
        empty = pa.table([pa.array([], t) for t in types], names=names)
        if not a.num_rows or not b.num_rows:
            return empty
        parts = _reduce((a["_q"], a["_v"]), (b["_e"], b["_v"]), reducer, arg, metric)
        tables = [empty]
        for qids, eids, score in parts:
            groups = [pa.array([key[i].as_py()] * len(qids), types[i]) for i in range(len(by))]
            tables.append(pa.table(
                [*groups, pa.array(qids, types[-3]), pa.array(eids, types[-2]),
                 pa.array(score, types[-1])], names=names))
        return pa.concat_tables(tables).combine_chunks()

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _scan_join(batch: pa.Table, q: DataFrame, e: DataFrame, by: list, k: int, max_cost,
               metric: str) -> DataFrame:
    """Nearest only: ``batch`` is broadcast, entries stay where they are."""
    shared = e.sparkSession.sparkContext.broadcast(batch)
    schema = _result_schema(e, by, q.schema["_q"].dataType, e.schema["_e"].dataType)
    fields = [(f.name, f.dataType) for f in schema]
    for c in by:
        values = pc.unique(batch[c]).to_pylist()
        if len(values) <= 1000:
            e = e.where(F.col(c).isin(*values) if values else F.lit(False))

    def groups(table):
        keys = table.select(by).to_pandas()
        return {key if isinstance(key, tuple) else (key,): pa.array(rows)
                for key, rows in keys.groupby(by, sort=False).indices.items()}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(t) for _, t in fields]
        requests = shared.value
        best = {}
        for key, rows in groups(requests).items():
            asked = requests.take(rows)
            best[key] = {dim: _Best(ids, m, k, metric)
                         for dim, (ids, m) in _by_dim(asked["_q"], asked["_v"]).items()}
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                for key, rows in groups(table).items():
                    if key in best:
                        part = table.take(rows)
                        for dim, (ids, m) in _by_dim(part["_e"], part["_v"], by_id=True).items():
                            if dim in best[key]:
                                best[key][dim].add(ids, m)
        for key, dims in best.items():
            for found in dims.values():
                qids, eids, score = found.result(max_cost)
                cols = [pa.array([v] * len(qids), t) for v, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(qids, types[-3]), pa.array(eids, types[-2]),
                     pa.array(score, types[-1])], names=[n for n, _ in fields])

    return e.mapInArrow(run, schema)


def small_batch(requests: DataFrame, by=("model",), request_id: str = "request_id",
                vector: str = "embedding"):
    """The request side as one Arrow table, or None when over the bound."""
    q = _side(requests, list(by), request_id, vector, "_q")
    batch = q.limit(SCAN_REQUESTS + 1).toArrow()
    if batch.num_rows <= SCAN_REQUESTS and batch.nbytes <= SCAN_BYTES:
        return batch
    return None


# --- operators ----------------------------------------------------------------

def knn(requests: DataFrame, entries: DataFrame, k: int = 1, metric: str = "l2",
        by=("model",), request_id: str = "request_id", entry_id: str = "id",
        vector: str = "embedding", method: str = "auto", tile_rows: int = TILE_ROWS,
        batch=None, max_cost: float = None) -> DataFrame:
    """Exact ``k`` nearest entries of each request inside its group.

    Returns ``by..., request_id, entry_id, score, position``; score is the
    squared distance or the cosine; ties go to the smaller entry id. ``method``
    is ``scan``, ``tiles`` or ``auto`` (scan only for a request batch counted
    and found small; ``batch`` is that batch when the caller has it).
    With ``max_cost`` (squared distance, or the negative cosine) tasks return no
    candidate worse than it, up to rounding; filter the result again.
    """
    if k < 1:
        raise ValueError("k must be positive")
    by = list(by)
    q = _side(requests, by, request_id, vector, "_q")
    e = _side(entries, by, entry_id, vector, "_e")
    if method == "tiles":
        batch = None
    elif batch is None:
        batch = small_batch(requests, by, request_id, vector)
    if method == "scan" and batch is None:
        raise ValueError("request batch too large to broadcast")
    if batch is not None:
        found = _scan_join(batch, q, e, by, k, max_cost, metric)
    else:
        found = _tile_join(q, e, by, "nearest", (k, max_cost), metric, tile_rows)
    cost = -F.col("score") if metric == "cosine" else F.col("score")
    if k == 1:
        best = (found.groupBy(*by, "_q")
                .agg(F.min(F.struct(cost.alias("cost"), F.col("_e"), F.col("score"))).alias("b")))
        return best.select(*by, F.col("_q").alias(request_id), F.col("b._e").alias(entry_id),
                           F.col("b.score").alias("score"), F.lit(1).alias("position"))
    order = Window.partitionBy(*by, "_q").orderBy(cost, "_e")
    return (found.withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= k)
            .select(*by, F.col("_q").alias(request_id), F.col("_e").alias(entry_id),
                    "score", "position"))


def tile_matches(q: DataFrame, e: DataFrame, by: list, radius: float, metric: str = "l2",
                 first_smaller: bool = False, tile_rows: int = TILE_ROWS, counts: DataFrame = None) -> DataFrame:
    """Matches within ``radius`` between frames of (by..., _q|_e, _v)."""
    return _tile_join(q, e, by, "first" if first_smaller else "within", radius, metric, tile_rows, counts)


def two_nearest(requests: DataFrame, entries: DataFrame, metric: str = "l2",
                by=("model",), **options) -> DataFrame:
    """One row per request with the list of its two nearest, nearest first."""
    pairs = knn(requests, entries, 2, metric, by, **options)
    return (pairs.groupBy(*by, "request_id")
            .agg(F.array_sort(F.collect_list(F.struct("position", "score", "id"))).alias("found"))
            .withColumn("found", F.transform("found", lambda r: F.struct(
                r["score"].alias("score"), r["id"].alias("id")))))
