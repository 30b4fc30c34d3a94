"""Helpers of the corpus operators: words of byte strings, Arrow batches, tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
#: lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(column: pa.Array):
    """The values as bytes, nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def code_points(data: bytes) -> int:
    return len(data.translate(None, CONTINUATION))


def slices(batches, rows: int):
    """The batches in pieces of at most ``rows`` rows, so that what a task makes of them stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def per_text(df: DataFrame, text: str, fn, out: str, keep=None, rows: int = None) -> DataFrame:
    """Columns made from a text column, beside the other columns.

    ``fn`` is called in each task and returns a function from a list of texts
    (bytes, None for null) to a dictionary of Arrow arrays as in ``out``, a DDL
    schema. ``keep`` maps names of the result to columns that are carried
    through; they travel in one struct, so their names cannot clash. With ``rows``
    tasks work on and return pieces of at most so many rows.
    """
    keep = keep or {}
    carried = F.struct(*[c.alias(n) for n, c in keep.items()]) if keep else F.struct(F.lit(1).alias("_"))
    given = df.select(carried.alias("carried"), col(text).cast("string").alias("text"))

    def work(batches):
        apply = fn()
        for batch in slices(batches, rows) if rows else batches:
            made = apply(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *made.values()], names=["carried", *made])

    schema = f"carried {given.schema['carried'].dataType.simpleString()}, {out}"
    made = given.mapInArrow(work, schema)
    names = [c for c in made.columns if c != "carried"]
    return made.select(*[F.col("carried").getField(n).alias(n) for n in keep], *names)


def ids_of(words: list) -> np.ndarray:
    """Numbers of the words, equal for equal words, in order of first use."""
    seen = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` consecutive ids, equal for equal runs."""
    code, size = ids, int(ids.max(initial=0)) + 1
    for k in range(1, width):
        code = np.unique(code[:-1] * size + ids[k:], return_inverse=True)[1]
    return code
