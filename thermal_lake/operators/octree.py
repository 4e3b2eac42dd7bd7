"""An octree over the points of each key, and exact nearest neighbours through it.

A point's place is a Morton code: its cell along each axis at ``LEVELS`` halvings of the key's extent, bits interleaved. A
cell is split in eight only while it holds more points than a tile should; so a dense spot gets small tiles and an
empty region none. The split is found from counts of cells, five levels at a time, and only points of cells that are still too
full are counted again. What is left after the last level (points nearly or exactly equal) is dealt out by hash.

A search packs neighbouring queries into blocks. A block meets its key's directory - one row with box and number of points of every
tile - and finds for each query a distance within which k points must lie, hence the tiles that may hold an answer; then the tiles
themselves, for the distances. Blocks of a key with a single tile meet that tile at once. No row per pair of query and point exists; every packed row has a bounded size:

* a tile holds about ``TILE`` points (or 2k, if that is more; in keys of over ``TILE * TILES`` points, their n / ``TILES``), so
* a directory has about ``TILES`` entries at most, whatever the number of points.

Rows with a NULL or non-finite coordinate are left out on both sides; queries of a key without points have no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import finite
from ..session import cut
from .packs import SLICE, entry, lists, packed, repeated, types_of
from .skew import broadcast_if_small

LEVELS, STEP = 20, 5
TILE, TILES = 512, 100_000
BROADCAST_ROWS = 200_000

# Spreading the bits of a number three places apart: shift left by n, or, keep these bits.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def placed(df: DataFrame) -> DataFrame:
    """Rows with three finite coordinates, as doubles."""
    out = df.withColumns({a: finite(F.col(a).cast("double")) for a in "xyz"})
    return out.where(" AND ".join(f"{a} IS NOT NULL" for a in "xyz"))


def extents(points: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Lower corner, edge of the enclosing cube, number of points and of points a tile may hold, per key."""
    e = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min(a).alias(f"_{a}0") for a in "xyz"], F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("_w"))
    return e.withColumns({"_edge": F.greatest(F.col("_w"), F.lit(1e-300)), "_most": F.greatest(F.lit(tile), F.ceil(F.col("_n") / TILES))}).drop("_w")


def coded(df: DataFrame) -> DataFrame:
    """Add ``_code``; places outside the cube count as on its border. Needs the columns of :func:`extents`."""
    cells = 1 << LEVELS
    out = df.withColumns({f"_m{a}": F.least(F.greatest(F.floor((F.col(a) - F.col(f"_{a}0")) / F.col("_edge") * cells), F.lit(0)), F.lit(cells - 1)) for a in "xyz"})
    for by, keep in SPREAD:
        out = out.withColumns({f"_m{a}": F.col(f"_m{a}").bitwiseOR(F.shiftleft(f"_m{a}", by)).bitwiseAND(F.lit(keep)) for a in "xyz"})
    code = F.shiftleft("_mx", 2).bitwiseOR(F.shiftleft("_my", 1)).bitwiseOR(F.col("_mz"))
    return out.withColumn("_code", code).drop("_mx", "_my", "_mz")


def _splits(keys: list[str], level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Level of the tile of every counted cell below one root: the first at which its ancestor is not too full."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, n, most = pdf["_cell"].to_numpy(), pdf["_c"].to_numpy(), int(pdf["_most"].iloc[0])
        depth = np.full(len(cell), -1)
        for d in range(STEP + 1):
            _, at = np.unique(cell >> (3 * (STEP - d)), return_inverse=True)
            fits = (depth < 0) & (np.bincount(at, n)[at] <= most)
            depth[fits] = level + d
        return pdf.assign(_depth=depth)[[*keys, "_cell", "_depth"]]

    return split


def tiled(points: DataFrame, keys: Sequence[str], copies: int | None = None, pid: str = "pid", full: bool | None = None) -> DataFrame:
    """Points (with ``_code`` and ``_most``) with their tile ``_tile`` (code of its first place) and ``_part``.

    ``copies`` keeps that many points, those with the smallest ``pid``, of points at one place in cells that the last level cannot
    split; for k nearest neighbours with ties to the smaller id, more are of no use. ``full`` says, where it is known, whether any key needs a split.
    """
    keys = list(keys)
    whole = lambda df: df.withColumns({"_tile": F.lit(0).cast("long"), "_part": F.lit(0)})
    if not (not points.where("_n > _most").isEmpty() if full is None else full):
        return whole(points)
    done, rest = [whole(points.where("_n <= _most"))], cut(points.where("_n > _most"))
    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    for level in range(0, LEVELS, STEP):
        low = 3 * (LEVELS - level - STEP)
        cell = F.shiftright("_code", low)
        counts = rest.groupBy(*keys, "_most", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
        roots = counts.withColumn("_root", F.shiftright("_cell", 3 * STEP)).groupBy(*keys, "_root")  # at most 8^STEP cells each
        map_ = cut(roots.applyInPandas(_splits(keys, level), f"{types}, _cell long, _depth int"))
        near = rest.withColumn("_cell", cell).join(broadcast_if_small(map_, BROADCAST_ROWS), [*keys, "_cell"]).drop("_cell")
        above = sum((F.when(F.col("_depth") == d, F.lit((1 << 3 * (LEVELS - d)) - 1)).otherwise(F.lit(0)) for d in range(level, level + STEP + 1)), F.lit(0))
        done.append(near.where("_depth >= 0").withColumns({"_tile": F.col("_code").bitwiseAND(F.bitwise_not(above)), "_part": F.lit(0)}).drop("_depth"))
        full = map_.where("_depth < 0").isEmpty()
        rest = near.where("_depth < 0").drop("_depth")
        if full:
            break
    else:
        if copies is not None:
            rest = rest.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "x", "y", "z").orderBy(pid))).where(F.col("_rn") <= copies).drop("_rn")
        rest = cut(rest)
        parts = rest.groupBy(*keys, "_code").agg(F.ceil(F.count(F.lit(1)) / F.max("_most")).alias("_parts"))
        rest = rest.join(broadcast_if_small(parts, BROADCAST_ROWS), [*keys, "_code"])
        done.append(rest.withColumns({"_tile": F.col("_code"), "_part": F.pmod(F.xxhash64(pid), F.col("_parts")).cast("int")}).drop("_parts"))
    return reduce(DataFrame.unionByName, done)


def _reach(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of every query to every box, and a distance within which k points must lie."""
    a, b = lo[None] - q[:, None], q[:, None] - hi[None]
    least = np.sqrt((np.maximum(np.maximum(a, b), 0) ** 2).sum(2))
    most = np.sqrt((np.maximum(np.abs(a), np.abs(b)) ** 2).sum(2))
    order = np.argsort(most, axis=1)
    held = np.cumsum(n[order], axis=1)
    at = (held < k).sum(1)
    far = np.take_along_axis(most, np.take_along_axis(order, np.minimum(at, len(n) - 1)[:, None], 1), 1)[:, 0]
    return least, np.where(at < len(n), far * (1 + 1e-12), np.inf)


def visits(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tile, queries, their bounds) of every tile that may hold one of the k nearest points of a query."""
    middle, half = (q.max(0) + q.min(0)) / 2, (q.max(0) - q.min(0)) / 2
    least, reach = _reach(middle[None], lo - half, hi + half, n, k)  # boxes widened by the block's half size
    tiles = np.flatnonzero(least[0] <= reach[0])
    parts = [_reach(q[i : i + 128], lo[tiles], hi[tiles], n[tiles], k) for i in range(0, len(q), 128)]
    least, reach = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    for t, some in zip(tiles, (least <= reach[:, None]).T, strict=True):
        if some.any():
            at = np.flatnonzero(some)
            yield int(t), at, reach[at]


def _smallest(at: np.ndarray, d: np.ndarray, pid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (query, distance, id) of the k first of each query, and their ranks from 1."""
    order = np.lexsort((pid, d, at))
    rank = np.arange(len(at)) - np.searchsorted(at[order], at[order]) + 1
    return order[rank <= k], rank[rank <= k]


def nearest(queries: DataFrame, points: DataFrame, keys: Sequence[str], qid: str, pid: str, k: int = 1, value: str | None = None) -> DataFrame:
    """The exact ``k`` nearest points of each query within its key: (keys, qid, pid, distance, rn), ties to the smaller ``pid``.

    Ids are whole numbers. ``value`` names a column of doubles that comes along with the points. Repeated points count as often as they
    occur; a query id that occurs twice in a key is searched twice.
    """
    keys = list(keys)
    spark = queries.sparkSession
    tile, block_rows = max(TILE, 2 * k), max(64, min(1024, 8192 // k))
    own = points.select(*keys, F.col(pid).cast("long").alias("_pid"), "x", "y", "z", *([F.col(value).cast("double").alias("_value")] if value else []))
    own = placed(own)
    size = cut(extents(own, keys, tile))
    frames = broadcast_if_small(size, BROADCAST_ROWS)
    cells = tiled(coded(own.join(frames, keys)), keys, k, "_pid", not size.where("_n > _most").isEmpty())
    content = F.collect_list(F.struct("_pid", "x", "y", "z", *(["_value"] if value else []))).alias("points")
    tiles = cut(cells.groupBy(*keys, "_tile", "_part").agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{a}{e}") for a in "xyz" for e, f in (("_lo", F.min), ("_hi", F.max))], content))
    box = F.struct("_tile", "_part", "n", *[f"{a}_{e}" for e in ("lo", "hi") for a in "xyz"])
    held = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
    alone, several = (not held.where(c).isEmpty() for c in ("_held = 1", "_held > 1"))
    directory = tiles.groupBy(*keys).agg(F.collect_list(box).alias("dir")).where(F.size("dir") > 1)

    asked = coded(placed(queries.select(*keys, F.col(qid).cast("long").alias("_qid"), "x", "y", "z")).join(frames, keys))
    key_types, nk = types_of(asked, keys), len(keys)
    blocks = packed(asked, keys, ["_code", "_qid"], ["_qid", "x", "y", "z"], block_rows)
    blocks = cut(blocks) if alone and several else blocks
    one_types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64()]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks whose key is one tile: what is nearest there is the answer."""
        def rows_of(b: pa.RecordBatch, found: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
            at = pa.array(np.repeat([r for r, _ in found], [len(f[0]) for _, f in found]))
            flat = [pa.array(np.concatenate([f[i] for _, f in found]), t) for i, t in enumerate(one_types[: 5 if value else 4])]
            return pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:nk]], *flat], [*keys, "_qid", "_pid", "distance", "rn", *(["_value"] if value else [])])

        for b in batches:
            found: list[tuple[int, list[np.ndarray]]] = []
            entries = 0
            for r in range(b.num_rows):
                qids, xs, ys, zs, points_ = b.columns[nk:]
                fields = [f.to_numpy(zero_copy_only=False) for f in points_[r].values.flatten()]
                d = np.sqrt(sum((entry(c, r)[:, None] - p[None]) ** 2 for c, p in zip((xs, ys, zs), fields[1:4], strict=True)))
                limit = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                i, j = np.nonzero(d <= limit[:, None])
                take, rank = _smallest(i, d[i, j], fields[0][j], k)
                i, j = i[take], j[take]
                found.append((r, [entry(qids, r)[i], fields[0][j], d[i, j], rank, *([fields[4][j]] if value else [])]))
                entries += len(i)
                if entries >= SLICE or r == b.num_rows - 1:
                    yield rows_of(b, found)
                    found, entries = [], 0

    found_schema = f"{key_types}, _qid long, _pid long, distance double, rn int" + (", _value double" if value else "")
    only = tiles.join(held.where("_held = 1"), keys, "left_semi").select(*keys, "points")
    answers = [blocks.join(only, keys).select(*keys, "_qid", "x", "y", "z", "points").mapInArrow(searched, found_schema)] if alone or not several else []

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                block, qids, xs, ys, zs, dir_ = b.columns[nk:]
                ids, q = entry(qids, r), np.stack([entry(c, r) for c in (xs, ys, zs)], 1)
                fields = [f.to_numpy(zero_copy_only=False) for f in dir_[r].values.flatten()]
                found = list(visits(q, np.stack(fields[3:6], 1), np.stack(fields[6:9], 1), fields[2], k))
                at = np.array([t for t, _, _ in found])
                rows = [(some, ids[some], *q[some].T, bound) for _, some, bound in found]
                yield pa.RecordBatch.from_arrays([*[repeated(c, r, len(found)) for c in b.columns[:nk]], repeated(block, r, len(found)), pa.array(fields[0][at]), pa.array(fields[1][at].astype(np.int32)),
                                                  *lists(rows, [pa.int32(), pa.int64(), *[pa.float64()] * 4])], [*keys, "_block", "_tile", "_part", "at", "qids", "xs", "ys", "zs", "bound"])

    wanted = blocks.join(directory, keys).select(*keys, "_block", "_qid", "x", "y", "z", "dir").mapInArrow(
        asks, f"{key_types}, _block long, _tile long, _part int, at array<int>, qids array<long>, xs array<double>, ys array<double>, zs array<double>, bound array<double>")
    found_types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    hit_schema = f"{key_types}, _block long, at array<int>, qids array<long>, pids array<long>, dists array<double>, vals array<double>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                at, qids, xs, ys, zs, bound, points_ = b.columns[nk + 1 :]
                fields = [f.to_numpy(zero_copy_only=False) for f in points_[r].values.flatten()]
                d = np.sqrt(sum((entry(c, r)[:, None] - p[None]) ** 2 for c, p in zip((xs, ys, zs), fields[1:4], strict=True)))
                limit = entry(bound, r)
                if d.shape[1] > k:
                    limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(d <= limit[:, None])
                take, _ = _smallest(i, d[i, j], fields[0][j], k)
                i, j = i[take], j[take]
                rows.append((entry(at, r)[i], entry(qids, r)[i], fields[0][j], d[i, j], fields[4][j] if value else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[: nk + 1], *lists(rows, found_types)], [*keys, "_block", "at", "qids", "pids", "dists", "vals"])

    hits = wanted.join(tiles.select(*keys, "_tile", "_part", "points"), [*keys, "_tile", "_part"]).select(
        *keys, "_block", "at", "qids", "xs", "ys", "zs", "bound", "points").mapInArrow(scored, hit_schema)

    def merged(t: pa.Table) -> pa.Table:
        at, qids, pids, dists, vals = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t[n].chunks]) for n in ("at", "qids", "pids", "dists", "vals"))
        take, rank = _smallest(at, dists, pids, k)
        first = pa.array(np.zeros(len(take), np.int64))
        columns = {c: t[c].combine_chunks().take(first) for c in keys} | {"_qid": qids[take], "_pid": pids[take], "distance": dists[take], "rn": rank.astype(np.int32)}
        return pa.table(columns | ({"_value": vals[take]} if value else {}))

    if several:
        answers.append(hits.groupBy("_block").applyInArrow(merged, found_schema))
    out = reduce(DataFrame.unionByName, answers)
    names = {"_qid": (qid, queries.schema[qid].dataType), "_pid": (pid, points.schema[pid].dataType), "_value": (value, None)}
    return out.select(*[(F.col(c).cast(t) if t is not None else F.col(c)).alias(n) for c in out.columns for n, t in [names.get(c, (c, None))]])
