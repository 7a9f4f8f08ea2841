"""Vector functions as Column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def quantise_scale(a: Column) -> Column:
    """The int8 step: the greatest magnitude over 127, 1 for a zero vector."""
    most = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(most > 0, most / 127).otherwise(F.lit(1.0))


def quantise(a: Column, scale: Column) -> Column:
    """int8 values; halves round towards plus infinity."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / scale + 0.5))).cast("tinyint"))


def linear_score(a: Column, weights: Column, bias: float) -> Column:
    """weights . a/|a| + bias; the bias alone for a zero vector."""
    size = norm(a)
    return F.when(size == 0, F.lit(bias)).otherwise(dot(a, weights) / size + bias)


def _blobs(rows: pa.Array, dtype: np.dtype) -> pa.Array:
    """The bytes of each row of a list column, all rows at once; null where a row is null or holds a null."""
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten()
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(dtype)
    ends = np.append(0, np.cumsum(lengths))
    nulls = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
    sound = (nulls[ends[1:]] == nulls[ends[:-1]]) & rows.is_valid().to_numpy(zero_copy_only=False)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends * values.itemsize), pa.py_buffer(values.tobytes())])
    return pc.if_else(pa.array(sound), whole, None).cast(pa.binary())


def as_blob(a: Column, kind: str) -> Column:
    """The bytes of a vector: little-endian 32-bit floats ("float") or signed bytes ("int8"); null if it or one of its numbers is."""
    dtype = np.dtype({"float": "<f4", "int8": "i1"}[kind])

    @F.arrow_udf(T.BinaryType())
    def pack(rows: pa.Array) -> pa.Array:
        return _blobs(rows, dtype)

    return pack(a)


def blob_rows(blobs: pa.Array, width: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For 'f4' (4 * width bytes) and 'i1' (width bytes): which rows have that length, and their numbers as a matrix; no other row is in either."""
    whole = pc.fill_null(blobs.cast(pa.large_binary()), b"")
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = whole.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lengths, out = np.diff(ends), {}
    for kind, size in (("f4", 4 * width), ("i1", width)):
        at = np.flatnonzero((lengths == size) & (size > 0))
        own = data[ends[:-1][at][:, None] + np.arange(size)] if len(at) else np.zeros((0, size), np.uint8)
        out[kind] = at, np.ascontiguousarray(own).view("<f4" if kind == "f4" else "i1").reshape(len(at), width)
    return out


def from_blob(blob: Column, width: int, scale: Column) -> Column:
    """The vector in 4 * width bytes (floats) or width bytes (int8, times scale); null for any other length."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unpack(blobs: pa.Array, scales: pa.Array) -> pa.Array:
        out, known = np.zeros((len(blobs), width)), np.zeros(len(blobs), bool)
        steps = scales.cast(pa.float64()).to_numpy(zero_copy_only=False)
        for kind, (at, rows) in blob_rows(blobs, width).items():
            out[at] = rows if kind == "f4" else rows * steps[at][:, None]
            known[at] = True
        ends = pa.array(np.append(0, np.cumsum(known * width)).astype(np.int32), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(ends, pa.array(out[known].ravel()))

    return unpack(blob, scale)


def most_similar(a: Column, others: Column) -> Column:
    """The greatest cosine of a with any of an array of vectors; null of none."""
    return F.array_max(F.transform(others, lambda o: cosine(a, o)))
