"""Rows packed into list columns: runs of rows with equal keys travel, and are worked on with numpy, as one row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut
from .skew import ROWS_PER_RANGE, is_hot

SLICE = 1 << 17  # list entries worked on together


def lists(parts: Sequence[Sequence[np.ndarray]], types: Sequence[pa.DataType]) -> list[pa.Array]:
    """One list column for each position of the given tuples of arrays, an entry per tuple."""
    out = []
    for i, t in enumerate(types):
        flat = np.concatenate([p[i] for p in parts]) if parts else np.zeros(0)
        out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(p[i]) for p in parts]]), pa.int32()), pa.array(flat, t)))
    return out


def entry(col: pa.Array, r: int) -> np.ndarray:
    """The list in row ``r`` of a list column."""
    return col[r].values.to_numpy(zero_copy_only=False)


def slices(batch: pa.RecordBatch, first: int, entries: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Runs of the batch's rows with about ``entries`` list entries at most (a longer list is a run of its own), each with the row
    number of every entry and the entries' values: of the list columns from ``first`` on, or of the fields of a list of structs there."""
    ends = np.cumsum(np.diff(batch.columns[first].offsets.to_numpy()))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + entries, "right")))
        part = batch.slice(at, to - at)
        row = np.repeat(np.arange(part.num_rows), np.diff(part.columns[first].offsets.to_numpy()))
        flat = [c.flatten() for c in part.columns[first:]]
        if pa.types.is_struct(flat[0].type):
            flat = flat[0].flatten()
        yield part, row, [v.to_numpy(zero_copy_only=False) for v in flat]
        at = to


def repeated(col: pa.Array, r: int, n: int) -> pa.Array:
    return col.take(pa.array(np.full(n, r)))


def types_of(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], rows: int, hot: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows (keys, _block, columns as lists) of at most ``rows`` rows with equal keys, neighbours in ``order``.

    Rows are written once and dealt out by key; if a key has more than ``hot`` rows, by ranges of (keys, order), so that it fills many
    tasks. ``_block`` numbers the packs.
    """
    keys, nk = list(keys), len(keys)
    df = cut(df.select(*dict.fromkeys([*keys, *order, *columns])))
    dealt = df.repartitionByRange(*keys, *order) if is_hot(df, keys, hot) else df.repartition(*keys)
    spread = dealt.sortWithinPartitions(*keys, *order).select(*keys, *columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            changed = np.zeros(b.num_rows, bool)
            for c in b.columns[:nk]:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(changed).tolist()] if b.num_rows else []
            cuts = [j for i, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True) for j in range(i, e, rows)] if cuts else []
            ends = pa.array([*cuts, b.num_rows] if cuts else [0], pa.int32())
            first = pa.array(cuts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(first) for c in b.columns[:nk]], pa.array(number + np.arange(len(cuts))), *[pa.ListArray.from_arrays(ends, c) for c in b.columns[nk:]]], [*keys, "_block", *columns])
            number += len(cuts)

    shape = [f"`{c}` array<{spread.schema[c].dataType.simpleString()}>" for c in columns]
    return spread.mapInArrow(pack, ", ".join([types_of(spread, keys), "_block long", *shape]))
