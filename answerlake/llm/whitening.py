"""Whitened embeddings by a block Jacobi-Davidson solver.

Each entry c of a vector becomes the integer x = floor(1024 * c) + 100000. With n vectors and
sums S per dimension, the covariance V = sum((x - S/n)(x - S/n)^T) / n is never formed:
the solver only asks for products V W of a few columns W, and each is one pass over the
vectors, in which a task multiplies its centred vectors and sends back sums of the size of
W. Vectors are centred in integers (n*x - S, exact) before anything is multiplied.

The solver (for the ``count`` largest eigenvalues):

1. Rayleigh-Ritz: the subspace Q and its product V Q give Ritz vectors and residuals.
2. A leading Ritz vector whose residual is down at double precision is locked: the others
   are kept orthogonal to it.
3. Each other leading Ritz vector u with value t asks for a correction s orthogonal to the
   locked and the leading vectors: P (V - t I) P s = -residual. All are solved side by side
   by ``inner`` steps of MINRES, so a step of all is one pass over the vectors.
4. The corrections are made orthonormal and join the subspace; a subspace over its bound
   restarts from its leading Ritz vectors. When a subspace fills the whole space its Ritz
   vectors are exact.

Cases: a vector that is null or holds null, NaN or infinite entries is dropped, and so is one
with an entry of 2**40 or more in size (beyond exact integers) or with another length than
most vectors have (ties: the longest); repeated rows count as often as they occur; null ids
are carried; directions without variance (at most 1e-12 of the largest) have no whitened
values and no rows; ``deviation`` fails rather than wrap beyond a long; an empty table gives
no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import col, table
from answerlake.runtime import cut_lineage, remove_folder, shared_dir

COUNT, SCALE, SHIFT = 8, 1024, 100_000
LARGEST = 1 << 40
INNER, ROUNDS = 10, 200
SUMS_AT_ONCE, CELLS_AT_ONCE = 256, 1 << 20


def _integers(dim):
    """Batches (id, vector) to (id, x as 64-bit integers), without unusable vectors."""
    def work(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(column.value_lengths().fill_null(-1))
            rows = np.flatnonzero(lengths == dim)
            if not len(rows):
                continue
            values = column.take(pa.array(rows)).flatten().cast(pa.float64())
            flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE
            good = (np.abs(flat) < LARGEST).all(axis=1)  # not so for NaN
            x = np.floor(flat[good]).astype(np.int64) + SHIFT
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[good])), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])
    return work


def _matrix(column, dim) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


class Centred:
    """Vectors as integers in a table (id, x), and products over all of them."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.vectors, self.dim, self.tasks = vectors, dim, vectors.rdd.getNumPartitions()
        first = self._summed(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), dim + 1, np.int64)
        self.n, self.sums = int(first[0]), first[1:]
        if self.n and int(np.abs(self.sums).max()) > (1 << 62):
            raise OverflowError("sums of the vectors do not fit a long")

    def _summed(self, part, size: int, kind=np.float64) -> np.ndarray:
        """The sum of ``part(x)`` over blocks of vectors; a row of ``size`` numbers for each task,
        added up in tasks first where tasks are many."""
        dim, step = self.dim, max(1, CELLS_AT_ONCE // self.dim)

        def blocks(batches):
            total, any_ = np.zeros(size, kind), False
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    total, any_ = total + part(_matrix(batch.column(0).slice(at, step), dim)).ravel(), True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        def added(batches):
            parts = [np.frombuffer(p, kind) for b in batches for p in b.column(0).to_pylist()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["part"])

        rows = self.vectors.select("x").mapInArrow(blocks, "part binary")
        if self.tasks > SUMS_AT_ONCE:
            rows = rows.repartition(SUMS_AT_ONCE).mapInArrow(added, "part binary")
        return sum((np.frombuffer(p, kind) for p in rows.toArrow()["part"].to_pylist()), np.zeros(size, kind))

    def product(self, w: np.ndarray) -> np.ndarray:
        """V w for the columns of ``w``: one pass."""
        n, sums = self.n, self.sums

        def part(x):
            c = (n * x - sums) / n
            return c.T @ (c @ w)
        return self._summed(part, w.size).reshape(w.shape) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(self._summed(lambda x: np.array([(((n * x - sums) / n) ** 2).sum()]), 1)[0] / n)

    def gram(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the projections on the columns of ``w``: centred mean of products."""
        n, sums, k = self.n, self.sums, w.shape[1]

        def part(x):
            y = ((n * x - sums) / n) @ w
            return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        out = self._summed(part, k + k * k) / n
        return out[k:].reshape(k, k) - np.outer(out[:k], out[:k])


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``new`` made orthonormal to ``basis`` and in itself; columns that vanish are left out."""
    out = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not size or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):  # repeated, as rounding leaves a rest
            for b in (basis, np.array(out).T.reshape(len(v), -1)):
                v = v - b @ (b.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            out.append(v)
    return np.array(out).T.reshape(len(new), -1)


def _minres(product, shifts: np.ndarray, rhs: np.ndarray, fixed: np.ndarray, steps: int) -> np.ndarray:
    """Approximate s with P (V - shift) P s = rhs for every column side by side, P the
    projection away from ``fixed``; each step is one product."""
    away = lambda v: v - fixed @ (fixed.T @ v)
    rhs = away(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    alive = beta > 0
    safe = lambda b: np.where(b > 0, b, 1.0)
    v, v_old = rhs / safe(beta), np.zeros_like(rhs)
    s, d, d_old = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    cos, cos_old, sin, sin_old = (np.full(len(beta), x) for x in (1.0, 1.0, 0.0, 0.0))
    phi, start, last = beta.copy(), beta.copy(), np.zeros(len(beta))
    for _ in range(steps):
        w = away(product(v) - v * shifts)
        alpha = (v * w).sum(axis=0)
        w = away(w - v * alpha - v_old * last)
        w -= v * (v * w).sum(axis=0)
        new = np.linalg.norm(w, axis=0)
        # the last two rotations on the new column of the tridiagonal matrix, then a new one
        far = sin_old * last
        near = cos * cos_old * last + sin * alpha
        diag = cos * alpha - sin * cos_old * last
        size = np.hypot(diag, new)
        alive &= size > 1e-14 * np.abs(shifts)
        cos_old, sin_old = cos, sin
        cos, sin = np.where(alive, diag / safe(size), 1.0), np.where(alive, new / safe(size), 0.0)
        d, d_old = np.where(alive, (v - d * near - d_old * far) / safe(size), 0.0), d
        s = s + np.where(alive, d * (phi * cos), 0.0)
        phi = -phi * sin
        alive &= (new > 1e-14 * np.abs(shifts)) & (np.abs(phi) > 1e-3 * start)
        if not alive.any():
            break
        v, v_old, last = w / safe(new), v, new
    return s


def jacobi_davidson(product, dim: int, count: int, inner: int = INNER, most: int = None, seed: int = 7):
    """(values, vectors, residuals) of the ``count`` largest eigenvalues of a symmetric,
    positive semidefinite operator that ``product`` applies to columns.

    Ends when every residual is down at double precision, or when rounding lets none get
    smaller any more.
    """
    count = min(count, dim)
    most = min(dim, most or max(5 * count, 20))
    eps, best, stale = np.finfo(float).eps, np.inf, 0
    q = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, 2 * count))), np.empty((dim, 0)))
    vq = product(q)
    for _ in range(ROUNDS):
        h = q.T @ vq
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        ritz, v_ritz = q @ turn[:, :count], vq @ turn[:, :count]
        rest = v_ritz - ritz * value[:count]
        size = np.linalg.norm(rest, axis=0)
        locked = size <= 16 * eps * np.sqrt(dim) * max(value[0], 0.0)
        worst = size.max()
        stale = 0 if worst < 0.5 * best else stale + 1
        best = min(best, worst)
        full = q.shape[1] == dim
        if locked.all() or (full and stale > 1) or stale > 8:
            break
        if q.shape[1] + int((~locked).sum()) > most and not full:
            keep = min(most - count, 2 * count)  # restart
            q, vq = q @ turn[:, :keep], vq @ turn[:, :keep]
            q, mix = np.linalg.qr(q)
            vq = np.linalg.solve(mix.T, vq.T).T
        open_ = ~locked
        step = _minres(product, value[:count][open_], -rest[:, open_], ritz, inner)
        new = _orthonormal(np.hstack([step, rest[:, open_]]) if step.shape[1] + q.shape[1] < dim else
                           np.hstack([step, rest[:, open_], np.eye(dim)]), q)[:, :int(open_.sum())]
        if not new.shape[1]:
            if full:  # the products are taken anew, so that no rounding of the steps stays
                q, _ = np.linalg.qr(q @ turn)
                vq = product(q)
            continue
        q, vq = np.hstack([q, new]), np.hstack([vq, product(new)])
    ritz = ritz / np.linalg.norm(ritz, axis=0)
    return value[:count], ritz, size


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COUNT) -> DataFrame:
    """A row per vector and component: key, component, n, deviation, whitened, explained,
    identity_error and the largest residual of the solver over the largest eigenvalue."""
    spark = embeddings.sparkSession
    folder, result = shared_dir(spark, "whitening"), shared_dir(spark, "whitening-rows")
    given = embeddings.select(col(key).alias("id"), col(vector).alias("x"))
    kind = given.schema["id"].dataType.simpleString()
    lengths = (given.where(F.size("x") > 0).groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.col("n").desc(), F.col("size").desc()).limit(1).collect())
    dim = lengths[0]["size"] if lengths else 1
    vectors = cut_lineage(given.mapInArrow(_integers(dim), f"id {kind}, x binary"), "vectors", folder)
    data = Centred(vectors, dim)
    n, sums = data.n, data.sums
    scale, basis, values, error, residual, total = np.empty(0), np.empty((dim, 0)), np.empty(0), 0.0, 0.0, 0.0
    if n:
        total = data.trace()
    if total > 0:
        values, basis, size = jacobi_davidson(data.product, dim, count)
        used = values > 1e-12 * values[0]
        values, basis, residual = values[used], basis[:, used], float(size[used].max() / values[0])
        basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
        scale = basis / np.sqrt(values)
        error = float(np.abs(data.gram(scale) - np.eye(len(values))).max())
    k = len(values)

    def rows(batches):
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            off = n * _matrix(batch.column(1), dim) - sums
            if float(np.abs(off).max()) ** 2 * dim < 2.0 ** 62:
                deviation = (off * off).sum(axis=1)
            else:
                deviation = np.array([sum(v * v for v in r) for r in off.tolist()], object)
            m, white = len(off), (off / n) @ scale
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k), pa.int64()), pa.array(white.ravel()),
                 pa.array(np.tile(values / total, m)), pa.array(np.full(m * k, error)), pa.array(np.full(m * k, residual))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    vectors.mapInArrow(rows, f"id {kind}, component int, n long, deviation long, whitened double, explained double, "
                             "identity_error double, residual double").write.parquet(result)
    remove_folder(spark, folder)  # the result reads none of its tables
    return spark.read.parquet(result).withColumnRenamed("id", key)


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
