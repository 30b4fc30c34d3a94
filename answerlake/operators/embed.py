"""Bulk embedding jobs: a caller's model on Arrow batches, and embeddings that
are plain table algebra over token vectors."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.functions.text import tokens
from answerlake.functions.vectors import as_double, is_finite
from answerlake.llm.common import slices
from answerlake.runtime import broadcast_if_small, cut_lineage, few_rows

VECTOR_ROWS, VECTOR_BYTES = 2_000_000, 64 << 20
SLICE_CELLS = 1 << 22
HELD_ROWS, HELD_SHARE = 1 << 18, 16


def embed_with(df: DataFrame, text_col: str, load: Callable, dim: int,
               out: str = "embedding") -> DataFrame:
    """Embed a text column with the caller's model.

    ``load()`` runs once per task and returns a function from a list of texts
    to an array of (texts, dim).
    """
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = np.asarray(model(texts.tolist()), dtype=np.float32)
            if vectors.shape != (len(texts), dim):
                raise ValueError(f"model returned shape {vectors.shape}, expected dim {dim}")
            yield pd.Series(list(vectors))

    return df.withColumn(out, embed(F.col(text_col)))


def _sums(by: list, vec: str, ordered: bool):
    """Batches (by..., n, vec) to rows of the same columns, summed over equal groups: inside
    each batch, or with ``ordered`` over a whole partition sorted by group, whose groups are
    held one at a time. Groups without a vector keep a row with n = 0."""
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            group = table.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            vectors = table[vec].combine_chunks()
            lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
            dim = int(lengths.max())
            known = (lengths == dim) & (dim > 0)
            matrix = np.zeros((table.num_rows, dim))
            if dim:
                matrix[known] = pc.list_flatten(vectors.filter(pa.array(known))).to_numpy(zero_copy_only=False).reshape(-1, dim)
            n = np.where(known, table["n"].to_numpy(), 0.0)
            keys = table.select(by).take(pa.array(order[first]))
            total, size = np.add.reduceat(matrix[order], first, axis=0), np.add.reduceat(n[order], first)
            held = yield from _merged(held, keys, total, size, vec) if ordered else _emitted(keys, total, size, vec)
        if held is not None:
            yield from _emitted(*held, vec)
    return run


def _emitted(keys: pa.Table, total: np.ndarray, size: np.ndarray, vec: str):
    offsets = np.arange(len(size) + 1, dtype=np.int32) * total.shape[1]
    out = keys.append_column("n", pa.array(size)).append_column(
        vec, pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel())))
    yield from out.combine_chunks().to_batches()


def _merged(held, keys: pa.Table, total: np.ndarray, size: np.ndarray, vec: str):
    """Emit all but the last group, which may go on; returns it."""
    if held is not None:
        if held[0].to_pylist() == keys.slice(0, 1).to_pylist():
            wide = max(held[1].shape[1], total.shape[1])
            grow = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
            total = grow(total)
            total[0] += grow(held[1])[0]
            size[0] += held[2][0]
        else:
            yield from _emitted(*held, vec)
    if len(size) > 1:
        yield from _emitted(keys.slice(0, len(size) - 1), total[:-1], size[:-1], vec)
    return keys.slice(len(size) - 1), total[-1:], size[-1:]


def _mean(rows: DataFrame, by: list, out: str, least: float = 0.0, vec: str = "vec") -> DataFrame:
    """Mean of (by..., n, vec) rows whose ``vec`` is already weighted by ``n``, at any width: whole
    arrays are summed per batch, the sums meet by group and are merged in order of groups.
    The mean of a group without vectors is null; ``least`` bounds the divisor from below."""
    rows = rows.select(*by, F.col("n").cast("double").alias("n"), F.col(vec).cast("array<double>").alias("vec"))
    parts = rows.mapInArrow(_sums(by, "vec", False), rows.schema)
    sums = parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(_sums(by, "vec", True), rows.schema)
    divisor = F.greatest("n", F.lit(least)) if least else F.col("n")
    mean = F.transform("vec", lambda x: x / divisor)
    return sums.select(*by, F.when((F.size("vec") > 0) & (divisor > 0), mean).alias(out))


class _TokenTable:
    """A token table measured to be small, as words and a matrix."""

    def __init__(self, rows: pa.Table, dim: int):
        vectors = rows["vec"].combine_chunks()
        self.words = rows["token"].combine_chunks()
        self.matrix = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), dim)

    def means(self, lists: pa.Array, window: int = None):
        """Mean vector of each list's known tokens, or of its windows' means; and whether there is one."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        owner = np.repeat(np.arange(len(lists)), lengths)
        group, groups = owner, len(lists)
        if window:
            windows = -(-lengths // window)
            starts, groups = np.cumsum(windows) - windows, int(windows.sum())
            group = starts[owner] + (np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]) // window
        at = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=self.words), -1))
        sums, n = self._summed(self.matrix, at[at >= 0], group[at >= 0], groups)
        if window:
            good = n > 0
            sums, n = self._summed(sums / np.maximum(n, 1)[:, None], np.flatnonzero(good),
                                   np.repeat(np.arange(len(lists)), windows)[good], len(lists))
        return sums / np.maximum(n, 1)[:, None], n > 0

    def parted(self, lists: pa.Array, window: int = None):
        """Per list and window (one at least): list, window, sum and number of the tokens held here; and the
        others as a table (row, window, token, count_all)."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        windows = np.maximum(-(-lengths // window), 1) if window else np.ones(len(lists), np.int64)
        starts, owner = np.cumsum(windows) - windows, np.repeat(np.arange(len(lists)), lengths)
        number = (np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]) // window if window else np.zeros(len(owner), np.int64)
        flat = pc.list_flatten(lists)
        at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=self.words), -1))
        held, other = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        sums, n = self._summed(self.matrix, at[held], (starts[owner] + number)[held], int(windows.sum()))
        rest = pa.table({"row": owner[other], "window": number[other], "token": flat.take(pa.array(other))})
        row = np.repeat(np.arange(len(lists)), windows)
        return row, np.arange(len(row)) - starts[row], sums, n, rest.group_by(["row", "window", "token"]).aggregate([([], "count_all")])

    @staticmethod
    def _summed(matrix, at, group, groups):
        """Sums of rows ``at`` by ``group`` (sorted), in slices of bounded size."""
        sums, step = np.zeros((groups, matrix.shape[1])), max(1, SLICE_CELLS // max(1, matrix.shape[1]))
        for s in range(0, len(at), step):
            own = group[s:s + step]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[first]] += np.add.reduceat(matrix[at[s:s + step]], first, axis=0)
        return sums, np.bincount(group, minlength=groups)


def _table_means(docs: DataFrame, id_col: str, words: Column, token_vectors: DataFrame, dim: int, out: str,
                 window: int = None) -> DataFrame:
    """Means by a token table that every task holds: no token leaves its text's row."""
    table = token_vectors.select("token", "vec").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(_TokenTable(table, dim))
    given = docs.select(id_col, words.alias("words"))

    def run(batches):
        for batch in batches:
            means, known = shared.value.means(batch.column(1), window)
            offsets = np.concatenate([[0], np.cumsum(np.where(known, means.shape[1], 0))]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(means[known].ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["id", "vec"])

    kind = given.schema[id_col].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, vec array<double>").select(F.col("id").alias(id_col), F.col("vec").alias(out))


def _held(docs: DataFrame, id_col: str, words: Column, token_vectors: DataFrame, dim: int) -> _TokenTable:
    """The vectors of at most ``HELD_ROWS`` tokens, the most frequent ones of a share of the texts. Which
    tokens they are only decides where their vectors are added, not what the sums are."""
    share = docs.where(F.pmod(F.xxhash64(id_col), F.lit(HELD_SHARE)) == 0).select(F.explode(words).alias("token"))
    most = max(1, min(HELD_ROWS, VECTOR_BYTES // (8 * dim + 64)))
    often = (share.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "token")
             .limit(most).select("token"))
    rows = token_vectors.select("token", "vec").where(F.size("vec") == dim)
    return _TokenTable(rows.join(F.broadcast(often), "token").toArrow(), dim)


def _token_sums(docs: DataFrame, id_col: str, words: Column, token_vectors: DataFrame, dim: int, window: int = None) -> DataFrame:
    """Rows (id, window, n, vec), ``vec`` weighted by ``n``, of the tokens of a text, for a table of any size: tasks hold
    the frequent tokens and add them where the text is; only the others leave it, once per window,
    and meet the table by token. Every text keeps a row for each window."""
    shared = docs.sparkSession.sparkContext.broadcast(_held(docs, id_col, words, token_vectors, dim))
    given = docs.select(id_col, words.alias("words"))
    names = ["id", "window", "token", "n", "vec"]

    def run(batches):
        for batch in slices(batches, 1000):
            row, number, sums, n, rest = shared.value.parted(batch.column(1), window)
            known = n > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(known, dim, 0))]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[known].ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number), pa.nulls(len(row), pa.string()),
                                              pa.array(n.astype(float)), vectors], names=names)
            if rest.num_rows:
                rest = rest.combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rest["row"].combine_chunks()), rest["window"].combine_chunks(),
                     rest["token"].combine_chunks().cast(pa.string()), rest["count_all"].combine_chunks().cast(pa.float64()),
                     pa.nulls(rest.num_rows, pa.list_(pa.float64()))], names=names)

    kind = given.schema[id_col].dataType.simpleString()
    parts = cut_lineage(given.mapInArrow(run, f"id {kind}, window long, token string, n double, vec array<double>"), "token-sums")
    weighted = F.transform("vec", lambda x: x.cast("double") * F.col("n"))
    # a token of many texts is held, so no key is hot here
    rest = (parts.where(F.col("token").isNotNull()).drop("vec").join(token_vectors.select("token", "vec"), "token")
            .select("id", "window", "n", weighted.alias("vec")))
    return parts.where(F.col("token").isNull()).select("id", "window", "n", "vec").unionByName(rest)


def embed_token_mean(docs: DataFrame, id_col: str, text_col: str, token_vectors: DataFrame,
                     dim: int, out: str = "embedding") -> DataFrame:
    """Mean of the vectors of a text's tokens (token_vectors: token, vec); null for a text without
    a known token. A token table measured to be small is held by every task."""
    words = tokens(F.col(text_col))
    if few_rows(token_vectors, VECTOR_ROWS, VECTOR_BYTES):
        return _table_means(docs, id_col, words, token_vectors, dim, out)
    sums = _token_sums(docs, id_col, words, token_vectors, dim)
    return _mean(sums, ["id"], out).withColumnRenamed("id", id_col)


def embed_masked_mean(rows: DataFrame, by: str, dim: int, vec: str = "vec", mask: str = "mask",
                      out: str = "embedding") -> DataFrame:
    """Mask-weighted mean of token vectors; the divisor is at least 1e-9."""
    weighted = rows.select(by, F.col(mask).cast("double").alias("n"), F.transform(
        vec, lambda x: x.cast("double") * F.col(mask)).alias("vec"))
    return _mean(weighted, [by], out, 1e-9)


def embed_long_windowed(docs: DataFrame, id_col: str, text_col: str, token_vectors: DataFrame,
                        dim: int, window: int = S.TOKEN_WINDOW,
                        out: str = "embedding") -> DataFrame:
    """Long texts: mean vector per window of tokens, then the plain mean of the
    window means. Texts of one window are simply averaged; a text without a known token is null."""
    words = tokens(F.col(text_col))
    if few_rows(token_vectors, VECTOR_ROWS, VECTOR_BYTES):
        return _table_means(docs, id_col, words, token_vectors, dim, out, window)
    windows = _mean(_token_sums(docs, id_col, words, token_vectors, dim, window), ["id", "window"], "vec")
    return _mean(windows.withColumn("n", F.lit(1)), ["id"], out).withColumnRenamed("id", id_col)


def embed_identity(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    """The text is its own key, for exact-match caches."""
    return df.withColumn(out, F.col(text_col))


def mm_concat(df: DataFrame, image: str = "image_vec", text: str = "text_vec") -> tuple:
    """(rows with ``embedding`` and ``mm_type``, rejects without any vector):
    image and text vectors joined end to end, or whichever exists."""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    tagged = (df.withColumn("mm_type", F.when(has(image) & has(text), "mm")
                            .when(has(image), "image").when(has(text), "text"))
              .withColumn("embedding", F.when(has(image) & has(text), F.concat(image, text))
                          .when(has(image), F.col(image)).when(has(text), F.col(text))))
    known = F.col("mm_type").isNotNull()
    return tagged.where(known), tagged.where(~known)


def pool_tokens(features: Column) -> Column:
    """Token features (tokens x channels) to the first token's vector."""
    return as_double(F.get(features, F.lit(0)))


def pool_spatial(features: Column) -> Column:
    """Feature maps (channels x height x width) to their spatial averages."""
    def mean(channel):
        cells = F.flatten(channel)
        total = F.aggregate(as_double(cells), F.lit(0.0), lambda a, x: a + x)
        return total / F.size(cells)
    return F.transform(features, mean)


def check_dimension(rows: DataFrame, collections: DataFrame, by=("model",),
                    vector: str = "embedding") -> tuple:
    """(rows whose vector has its collection's dimension, rejects). A dimension
    below one, a missing vector, a null, NaN or infinite element or an unknown collection
    rejects too."""
    dims = collections.select(*by, F.col("dim").alias("_dim"))
    sized = rows.join(broadcast_if_small(dims), list(by), "left")
    good = F.coalesce((F.col("_dim") > 0) & (F.size(vector) == F.col("_dim"))
                      & is_finite(F.col(vector)), F.lit(False))
    return sized.where(good).drop("_dim"), sized.where(~good).drop("_dim")
