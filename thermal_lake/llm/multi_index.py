"""Nearest neighbours by inner product through an inverted multi-index.

Both halves of the vectors are quantised on their own, K centroids each, so that an entry lies in one of K x K cells. A query
sorts the centroids of either half by inner product; a heap then yields pairs of centroids by falling sum (a pair is pushed when
both pairs before it have been popped), and their cells are read until enough entries are at hand. These are scored exactly.

What is fixed and what follows the data:

* The centroids are fitted on at most ``SAMPLE`` vectors, those with the smallest hashes. Every vector is indexed.
* How many entries are enough is measured at each build: at most ``PROBES`` queries are compared with *all* entries, and the
  depth is where the traversal has passed the share ``recall`` of their true neighbours. Vectors without structure need about
  half of all entries for 0.95, clustered ones far fewer.
* K grows with the root of the number of entries, up to ``MOST``; so the table of cell sizes has ``MOST`` squared numbers at most.
* Entries lie in blocks of about ``BLOCK`` rows: small cells share one, a large cell has several. A block is one row, so that a
  cell with a third of all entries is scored in many tasks. Queries go to blocks in chunks; no row per pair is ever made.
* Of equal vectors the k+1 smallest ids are kept as entries: ties go to the smaller id, so no other copy can be among
  the k nearest. Equal queries are searched once.

Cases: vectors that are null, empty, all zero, hold null, NaN or infinite entries, or have another length than most, take no
part, nor do rows without id. Repeated rows (equal id and vector) count once; an id with different vectors has one entry and one
search for each, and a search leaves out all entries of its own id. Fewer candidates than k give them all. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermal_lake.session import cut

from .vectors import matrix, packed, unpacked, usable

SAMPLE = 20_000
PROBES = 256
MOST = 256
BLOCK = 4096
CHUNK = 512
ROUNDS = 12

INDEX = "id long, v binary, cell int"
HITS = "rep long, id long, score double"


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """k centroids by Lloyd's rounds from the first rows; a centroid without rows stays where it is."""
    c = sample[:k].copy()
    for _ in range(ROUNDS):
        at = nearest(sample, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, sample[:, i], len(c)) for i in range(c.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The closest centroid of every row, in pieces of bounded size."""
    squares = (c * c).sum(1)
    return np.concatenate([np.argmin(squares - 2 * (x[i : i + BLOCK] @ c.T), 1) for i in range(0, len(x), BLOCK)] or [np.zeros(0, np.int64)])


class Codebook:
    """Centroids of both halves."""

    def __init__(self, sample: np.ndarray, entries: int):
        self.d = sample.shape[1]
        self.half = max(1, self.d // 2)
        k = 2
        while k < MOST and 32 * (2 * k) ** 2 <= entries:
            k *= 2
        self.first, self.second = fit(sample[:, : self.half], min(k, len(sample))), fit(sample[:, self.half :], min(k, len(sample)))
        self.cells = len(self.first) * len(self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.half] @ self.first.T, q[:, self.half :] @ self.second.T


def traverse(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """Cells by falling a[i] + b[j]: the multi-sequence walk with a heap."""
    first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    x, y = (-a[first]).tolist(), (-b[second]).tolist()
    n, m = len(x), len(y)
    first, second = (first * m).tolist(), second.tolist()
    seen = [0] * (n + 1)  # columns passed in each row; a row's pairs are popped in order
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        seen[i] = j + 1
        yield first[i] + second[j]
        if i + 1 < n and seen[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < m and (i == 0 or seen[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def cells_read(book: Codebook, q: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Which cells each query reads: the first of its walk that hold ``depth`` entries together."""
    out = np.zeros((len(q), book.cells), bool)
    held = sizes.tolist()
    for row, a, b in zip(out, *book.scores(q), strict=True):
        left = depth
        for cell in traverse(a, b):
            if left <= 0:
                break
            if held[cell]:
                row[cell] = True
                left -= held[cell]
    return out


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, read: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, score) of the k best entries that each query reads, ties to the smaller id.

    The product picks what may be among them; their scores are then summed one way for all, so that equal vectors tie exactly.
    """
    rough = q @ x.T
    if read is not None:
        rough[~read] = -np.inf
    if x.shape[0] > k:
        edge = np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k]
        slack = 1e-13 * x.shape[1] * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
        may = rough >= np.where(np.isfinite(edge), edge - slack, -np.finfo(float).max)[:, None]
    else:
        may = np.isfinite(rough)
    at, entry = np.nonzero(may)
    score = np.concatenate([(q[at[i : i + BLOCK]] * x[entry[i : i + BLOCK]]).sum(1) for i in range(0, len(at), BLOCK)] or [np.zeros(0)])
    order = np.lexsort((ids[entry], -score, at))
    at, entry, score = at[order], entry[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], entry[rank < k], score[rank < k]


def build(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20) -> tuple[DataFrame, Codebook | None]:
    """Entries ``id``, ``v`` (binary), ``cell`` of every vector, written once, and the codebook."""
    rows, d = usable(df, id_col, vector)
    rows = rows.where(F.col("id").isNotNull()).where(F.exists("v", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow() if d else None
    if sample is None or not sample.num_rows:
        return rows.sparkSession.createDataFrame([], INDEX), None
    book = Codebook(np.concatenate([matrix(c, d) for c in sample["v"].chunks]), rows.count())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), d) + 0.0  # no negative zero, so equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([b.column(0), packed(x), pa.array(book.cell(x), pa.int32())], ["id", "v", "cell"])

    return cut(rows.mapInArrow(coded, INDEX).groupBy("v", "id").agg(F.first("cell").alias("cell"))), book


def search(entries: DataFrame, book: Codebook | None, is_query: Callable[[Column], Column], k: int = 20, recall: float = 0.95) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest found of every entry whose id ``is_query`` accepts."""
    spark = entries.sparkSession
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = cut(entries.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"))
    asked = entries.where(is_query(F.col("id")))
    reps = cut(asked.groupBy("v").agg(F.min("id").alias("rep"), F.first("cell").alias("cell")))
    sizes = np.zeros(book.cells, np.int64)
    for row in kept.groupBy("cell").count().toLocalIterator():
        sizes[row["cell"]] = row["count"]
    depth = depth_for(kept, reps, book, sizes, k, recall)
    start, parts = blocks(sizes)

    def packs(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks()
        return pa.table({"block": [t["block"][0].as_py()], "cells": [t["cell"].to_numpy().astype(np.int32).tobytes()],
                         "ids": [t["id"].to_numpy().astype(np.int64).tobytes()], "x": [b"".join(t["v"].to_pylist())]})

    def block_of(batches):
        for b in batches:
            cell = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(start[cell] + b.column(3).to_numpy() % parts[cell], pa.int64())], ["id", "v", "cell", "block"])

    spread = kept.select("id", "v", "cell", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).alias("h"))
    stored = spread.mapInArrow(block_of, INDEX + ", block long").groupBy("block").applyInArrow(packs, "block long, cells binary, ids binary, x binary")

    groups: dict[int, list[int]] = {}  # cells that share a block, by its number; a cell with several blocks is alone
    for cell in np.flatnonzero(sizes).tolist():
        groups.setdefault(int(start[cell]), []).append(cell)

    def asks(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                q, rep = unpacked(part.column(1), book.d), part.column(0).to_numpy()
                read = cells_read(book, q, sizes, depth)
                for block, cells in groups.items():
                    mask = read[:, cells]
                    if (some := mask.any(1)).any():
                        ask = [rep[some].tobytes(), q[some].tobytes(), np.packbits(mask[some], axis=1).tobytes()]
                        for part_of in range(int(parts[cells[0]])):
                            yield pa.RecordBatch.from_arrays([pa.array([block + part_of]), *(pa.array([x]) for x in ask)], ["block", "reps", "q", "read"])

    wanted = reps.select("rep", "v", "cell").repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep").select("rep", "v")
    sent = wanted.mapInArrow(asks, "block long, reps binary, q binary, read binary")

    def scored(batches):
        for b in batches:
            for r in range(b.num_rows):
                reps_, q, read, cells, ids, x = (c[r].as_py() for c in b.columns)
                q, x = np.frombuffer(q).reshape(-1, book.d), np.frombuffer(x).reshape(-1, book.d)
                cells, ids, reps_ = np.frombuffer(cells, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(reps_, np.int64)
                here = np.unique(cells)
                mask = np.unpackbits(np.frombuffer(read, np.uint8).reshape(len(q), -1), axis=1, count=len(here)).astype(bool)
                at, entry, score = best(q, x, ids, mask[:, np.searchsorted(here, cells)], k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(reps_[at]), pa.array(ids[entry]), pa.array(score)], ["rep", "id", "score"])

    hits = sent.join(stored, "block").select("reps", "q", "read", "cells", "ids", "x").mapInArrow(scored, HITS)
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "id"))).where(F.col("rn") <= k + 1)
    lists = ranked.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("rn", "id", "score"))).alias("near"))
    out = asked.select(F.col("id").alias("query_id"), "v").join(reps.select("v", "rep"), "v").join(lists, "rep")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    flat = out.select("query_id", F.posexplode(others).alias("at", "hit"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: neighbouring small cells share a block, large cells have several."""
    start, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // BLOCK))
    block, held = 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        start[cell] = block
        if n > BLOCK:
            block, held = block + int(parts[cell]), 0
        else:
            held += n
    return start, parts


def depth_for(kept: DataFrame, reps: DataFrame, book: Codebook, sizes: np.ndarray, k: int, recall: float) -> int:
    """Entries to read so that the probes find the share ``recall`` of their k nearest among all entries."""
    probes = reps.orderBy(F.xxhash64("rep"), "rep").limit(PROBES).select("rep", "v").toArrow()
    if not probes.num_rows:
        return 0
    q = np.concatenate([unpacked(c, book.d) for c in probes["v"].chunks])

    def exact(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                at, entry, score = best(q, unpacked(part.column(1), book.d), part.column(0).to_numpy(), None, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part.column(2).to_numpy()[entry]), pa.array(part.column(0).to_numpy()[entry]), pa.array(score)], ["probe", "cell", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
    truth = kept.select("id", "v", "cell").mapInArrow(exact, "probe long, cell int, id long, score double").withColumn("rn", rank).where(F.col("rn") <= k + 1)
    place = np.zeros((len(q), book.cells), np.int64)  # entries before each cell on the probe's walk
    for row, a, b in zip(place, *book.scores(q), strict=True):
        walk = np.fromiter(traverse(a, b), np.int64, book.cells)
        row[walk] = np.cumsum(sizes[walk]) - sizes[walk]
    found = truth.select("probe", "cell").toPandas()
    at = np.sort(place[found["probe"], found["cell"]])
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1
