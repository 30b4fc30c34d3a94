"""Stored float32 bytes to vector columns and back."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _with(df, name, data_type):
    return T.StructType([f for f in df.schema.fields if f.name != name]
                        + [T.StructField(name, data_type)])


def decode_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Byte column to ``array<float>``; a wrong byte count and an element that is NaN
    or infinite give null (reject it with ``check_dimension``). Works on Arrow buffers,
    without per-row objects."""
    schema = _with(df, column, T.ArrayType(T.FloatType()))

    def run(batches):
        for batch in batches:
            raw = batch.column(column).cast(pa.binary())
            sized = pc.fill_null(pc.equal(pc.binary_length(raw), 4 * dim), False)
            kept = raw.filter(sized)
            _, offsets, data = kept.buffers()
            ends = np.frombuffer(offsets, np.int32)[kept.offset:kept.offset + len(kept) + 1] if len(kept) else [0, 0]
            flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view("<f4") if len(kept) else np.empty(0, "<f4")
            good = sized.to_numpy(zero_copy_only=False).copy()
            finite = np.isfinite(flat.reshape(-1, dim)).all(axis=1)
            good[good] = finite
            flat = flat.reshape(-1, dim)[finite].ravel()
            ends = np.concatenate([[0], np.cumsum(np.where(good, dim, 0))]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~good))
            rest = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), vectors],
                                             names=[*rest, column])

    return df.mapInArrow(run, schema)


def encode_vectors(df: DataFrame, column: str) -> DataFrame:
    """``array<float>`` to float32 bytes, for stores that keep a byte column."""
    schema = _with(df, column, T.BinaryType())

    def run(batches):
        for batch in batches:
            rows = batch.column(column)
            flat = pc.list_flatten(rows).to_numpy(zero_copy_only=False).astype("<f4")
            size = 4 * pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes())
            raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(flat.tobytes())])
            raw = pc.if_else(rows.is_valid(), raw, None)
            rest = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), raw],
                                             names=[*rest, column])

    return df.mapInArrow(run, schema)
