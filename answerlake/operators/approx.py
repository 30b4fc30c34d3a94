"""Approximate vector search: cells (IVF) and hash tables (LSH).

Both only choose which requests and entries meet; the meeting itself is the
tiled exact join, so a crowded cell or bucket is split over many tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.operators.vector_join import _by_dim, knn
from answerlake.runtime import cut_lineage

PROBES = 10
MAX_CELLS = 4096


def _probe(df: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """Add the ``probes`` nearest centers of each vector as rows."""
    shared = df.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = shared.value
        cc = (c * c).sum(1)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cells = [None] * table.num_rows
            for rows, m in _by_dim(pa.array(np.arange(table.num_rows)), table["embedding"]).values():
                if m.shape[1] != c.shape[1]:
                    continue
                near = np.argsort(cc - 2 * (m @ c.T), axis=1, kind="stable")[:, :probes]
                for r, row in zip(rows, near):
                    cells[r] = row.tolist()
            yield from table.append_column(
                "cells", pa.array(cells, pa.list_(pa.int32()))).to_batches()

    return df.mapInArrow(run, schema).withColumn("cell", F.explode("cells")).drop("cells")


def _merge(found: DataFrame, by: list, k: int, metric: str) -> DataFrame:
    """Best ``k`` over the cells or tables a request took part in."""
    from pyspark.sql import Window
    cost = -F.col("score") if metric == "cosine" else F.col("score")
    order = Window.partitionBy(*by, "request_id").orderBy(cost, "id")
    return (found.select(*by, "request_id", "id", "score").distinct()
            .withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= k))


def fit_cells(entries: DataFrame, cells: int, seed: int = 1) -> np.ndarray:
    """K-means centers of the entry vectors (``cells`` x dimension, bounded)."""
    if cells > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    points = entries.where(F.col("embedding").isNotNull()).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(points).clusterCenters())


def knn_ivf(requests: DataFrame, entries: DataFrame, k: int = 1, metric: str = "l2",
            by=("model",), cells: int = 64, probes: int = PROBES, centers=None) -> DataFrame:
    """Nearest ``k`` among the entries in the ``probes`` cells nearest to a request."""
    by = list(by)
    centers = fit_cells(entries, cells) if centers is None else centers
    # written once: tiles are counted before they are joined
    q = cut_lineage(_probe(requests.select(*by, "request_id", "embedding"), centers, probes),
                    "request-cells")
    e = cut_lineage(_probe(entries.select(*by, "id", "embedding"), centers, 1), "entry-cells")
    return _merge(knn(q, e, k, metric, by=[*by, "cell"], method="tiles"), by, k, metric)


def knn_lsh(requests: DataFrame, entries: DataFrame, k: int = 1, by=("model",),
            bucket_length: float = 0.4, tables: int = 8, seed: int = 1) -> DataFrame:
    """Nearest ``k`` (squared distance) among entries sharing a hash bucket."""
    by = list(by)
    vec = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", seed=seed,
                                      bucketLength=bucket_length, numHashTables=tables)
    asked = requests.where(F.col("embedding").isNotNull()).select(*by, "request_id", "embedding", vec)
    stored = entries.where(F.col("embedding").isNotNull()).select(*by, "id", "embedding", vec)
    model = lsh.fit(stored)

    def buckets(df):
        from pyspark.ml.functions import vector_to_array
        hashed = model.transform(df).drop("features")
        return hashed.select(
            *[c for c in hashed.columns if c != "hashes"],
            F.posexplode("hashes").alias("table", "h")).withColumn(
            "bucket", vector_to_array("h")[0].cast("long")).drop("h")

    found = knn(buckets(asked), buckets(stored), k, by=[*by, "table", "bucket"], method="tiles")
    return _merge(found, by, k, "l2")
