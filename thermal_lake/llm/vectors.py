"""Rows with usable vectors, and vectors of an Arrow batch as one numpy matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """Columns ``id`` and ``v`` (array of double) of the rows whose vector is neither null nor empty and has finite entries only.

    Vectors of different lengths have no common space: the most frequent length counts (the larger of equals), other rows
    are left out. Returns the rows and that length, 0 if there is none.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.size("v") > 0).where(F.forall("v", finite))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if lengths is None:
        return rows.where("false"), 0
    return rows.where(F.size("v") == lengths["d"]), lengths["d"]


def finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # NaN counts as larger than any number


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """The vectors of a list column, a row each."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())]).cast(pa.binary())


def unpacked(col: pa.Array, d: int) -> np.ndarray:
    """The inverse of :func:`packed` for doubles."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, d)
