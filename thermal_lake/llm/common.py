"""Helpers that the operators of this subpackage share: reading tables and looking at text as bytes.

Texts are handled as the UTF-8 bytes that Arrow already holds, in slices of about ``SLICE`` bytes, so a task
needs a few dozen MB whatever its partition holds. One text is never cut: a slice has one row at least.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 18
BLANK = re.compile("[\x20\x09-\x0d]+")

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: What operators remember in a worker process from task to task; each entry forgets it.
MEMORIES: list[Callable[[], None]] = []


def tidy() -> None:
    """Called where a task begins: let go of what other operators have left in this worker process, which outlives its stages."""
    for forget in MEMORIES:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


BATCH_ROWS = 512


def bounded(spark: SparkSession) -> None:
    """Let Spark hand texts to Python some MB at a time; its default of 10 000 rows is meant for narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a larger one is joined by shuffling. Give a narrow, written table."""
    return F.broadcast(df) if df.count() <= most else df


def words_in(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of one text; the plain form of :func:`words_of`."""
    return [w for w in BLANK.split(text or "") if w]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``most`` bytes of ``column`` each, or one row."""
    if not batch.num_rows:
        return
    _, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and where each begins; a null is an empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 2 * SLICE)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[k : k + 1] = [p]
    return _powers


def span_hash(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for every pair of bounds, the same wherever the span lies."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def sums_of(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags within each pair of consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


@dataclass
class Words:
    """Words of several texts: s, e are byte bounds; words at[d]:at[d+1] belong to text d."""

    data: np.ndarray
    offs: np.ndarray
    s: np.ndarray
    e: np.ndarray
    at: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hash(byte_values(LOWER[self.data] if lower else self.data), self.s, self.e)


def words_of(data: np.ndarray, offs: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; texts without words have none."""
    n = len(data)
    inside = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    s = np.flatnonzero(inside & (~before | edge[:n]))
    e = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offs, s, e, np.searchsorted(s, offs))


def windows(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of k words that lies in one text, and the text of each."""
    count = np.diff(at)
    n = np.maximum(count - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[:-1][doc]
    return first, doc
