"""Occupancy grids: overlap, components, distance transform."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from ..session import cut
from .grid import VOXEL
from .packs import repeated, slices, types_of

SLAB = 8  # planes per group of the distance transform
SIDE = 21  # bits per coordinate in a packed voxel id


def packed(ix: Column, iy: Column, iz: Column) -> Column:
    """One long per voxel; coordinates are in 0 .. 2^21 - 1."""
    as_long = lambda c: c.cast("long")
    return F.shiftleft(as_long(ix), 2 * SIDE).bitwiseOR(F.shiftleft(as_long(iy), SIDE)).bitwiseOR(as_long(iz))


def overlap_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occupied voxels of a, of b and of both on a common grid.

    Both sides are tagged and counted in one aggregate per voxel, which is the shuffle a full
    outer join would need, and the second aggregate is combined map-side.
    """
    on = [*keys, *VOXEL]
    tag = lambda df, x, y: df.where("occ").select(*on, F.lit(x).alias("_a"), F.lit(y).alias("_b"))
    per = tag(a, 1, 0).unionByName(tag(b, 0, 1)).groupBy(*on).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_b")).alias("n_both"))


def overlap_metrics(counts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Volumes, Dice, IoU, coverage of b and share of a outside b, in percent."""
    v = resolution**3
    a, b, both = F.col("n_a") * v, F.col("n_b") * v, F.col("n_both") * v
    pct = lambda x, y: 100 * F.try_divide(x, y)
    return counts.withColumns({
        "v_a": a, "v_b": b, "v_both": both, "v_out": a - both, "dice": pct(2 * both, a + b), "iou": pct(both, a + b - both),
        "coverage": pct(both, b), "outside": pct(a - both, a)})


def neighbour_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """6 or 26 in space, 8 in the plane."""
    every = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]
    if connectivity == 6:
        return [o for o in every if sum(map(abs, o)) == 1]
    if connectivity == 8:
        return [o for o in every if o[2] == 0]
    return every


def components(occupied: DataFrame, keys: Sequence[str], connectivity: int = 26, block: int = 32) -> DataFrame:
    """Connected components of occupied voxels: adds ``root`` (smallest packed id of the component).

    Blocks of ``block`` cells per axis are labelled on their own, in slices of a bounded number of cells, so hundreds of
    small clouds cost little more than one; then only the labels that touch across block faces form a graph, which is contracted by
    repeated hooking to the smallest neighbour. The graph is orders of magnitude smaller than the
    voxel table, and the number of rounds grows with its logarithm, not with its diameter.
    """
    keys = list(keys)
    key_types = ", ".join(f"{k} {occupied.schema[k].dataType.simpleString()}" for k in keys)
    offsets = neighbour_offsets(connectivity)
    cols = [*keys, *VOXEL]
    flat = connectivity == 8
    edge = block if not flat else block * block // 4

    nk = len(keys)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, row, xyz in slices(whole, nk):
                xyz = [v.astype(np.int64) for v in xyz]
                order = np.lexsort((xyz[2], xyz[1], xyz[0], row))
                row, xyz = row[order], [v[order] for v in xyz]
                ids = (xyz[0] << 2 * SIDE) | (xyz[1] << SIDE) | xyz[2]
                root = numerics.block_components(row, [v % edge for v in xyz], edge, offsets)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in b.columns[:nk]], *[pa.array(v.astype(np.int32)) for v in xyz], pa.array(ids), pa.array(ids[root])], [*cols, "id", "local"])

    bins = [F.floor(F.col(c) / edge).alias(f"_b{c}") for c in VOXEL]
    blocks = occupied.select(*cols).groupBy(*keys, *bins).agg(F.collect_set(F.struct(*[F.col(c).cast("int").alias(c) for c in VOXEL])).alias("cells"))
    local = cut(blocks.select(*keys, "cells").mapInArrow(label, f"{key_types}, ix int, iy int, iz int, id long, local long"))
    on_face = F.lit(False)
    for c in VOXEL[: 2 if flat else 3]:
        on_face = on_face | F.pmod(F.col(c), F.lit(edge)).isin(0, edge - 1)
    rim = local.where(on_face)
    half = [o for o in offsets if o > (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", o)]) for o in half]))
    away = rim.withColumn("_o", step).select(
        *keys, "local", (F.col("ix") + F.col("_o.x")).alias("jx"), (F.col("iy") + F.col("_o.y")).alias("jy"), (F.col("iz") + F.col("_o.z")).alias("jz"),
        *[F.floor(F.col(c) / edge).alias(f"_b{c}") for c in VOXEL])
    crosses = F.lit(False)
    for c, j in zip(VOXEL, ("jx", "jy", "jz")):
        crosses = crosses | (F.floor(F.col(j) / edge) != F.col(f"_b{c}"))
    away = away.where(crosses & (F.col("jx") >= 0) & (F.col("jy") >= 0) & (F.col("jz") >= 0)).select(
        *keys, F.col("local").alias("a"), packed(F.col("jx"), F.col("jy"), F.col("jz")).alias("id"))
    links = away.join(rim.select(*keys, "id", F.col("local").alias("b")), [*keys, "id"]).where("a != b").select(*keys, "a", "b").distinct()
    roots = contract(links, keys)
    merged = local.join(roots.select(*keys, F.col("node").alias("local"), "root"), [*keys, "local"], "left")
    return merged.select(*cols, F.coalesce("root", "local").alias("root"))


def contract(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest reachable node of every node in an undirected link table (keys, a, b)."""
    keys = list(keys)
    both = lambda df: df.select(*keys, "a", "b").unionByName(df.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = cut(both(links))
    nodes = edges.select(*keys, F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        hook = edges.groupBy(*keys, "a").agg(F.min("b").alias("p")).where("p < a")
        up = hook.select(*keys, F.col("a").alias("p"), F.col("p").alias("q"))
        hook = cut(hook.join(up, [*keys, "p"], "left").select(*keys, "a", F.coalesce("q", "p").alias("p")))
        nodes = cut(nodes.join(hook.select(*keys, F.col("a").alias("root"), F.col("p").alias("_n")), [*keys, "root"], "left").select(
            *keys, "node", F.coalesce("_n", "root").alias("root")))
        ends = [hook.select(*keys, F.col("a").alias(e), F.col("p").alias(f"_{e}")) for e in "ab"]
        moved = edges.join(ends[0], [*keys, "a"], "left").join(ends[1], [*keys, "b"], "left").select(
            *keys, F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        # A parent that has itself moved on keeps a link to where it went.
        chain = hook.select(*keys, F.col("p").alias("a")).distinct().join(ends[0], [*keys, "a"]).select(*keys, "a", F.col("_a").alias("b"))
        edges = cut(both(moved.unionByName(chain)))
    return nodes


def region_counts(occupied: DataFrame, keys: Sequence[str], connectivity: int = 26) -> DataFrame:
    """Number of separate regions of each cloud; one region means ``single``."""
    roots = components(occupied, keys, connectivity).groupBy(*keys, "root").count()
    return roots.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_regions")).withColumn("single", F.col("n_regions") == 1)


def largest_component(labelled: DataFrame, keys: Sequence[str], min_area: int = 1, score: Column | None = None) -> DataFrame:
    """Voxels of the best component of at least ``min_area`` cells (largest, or highest ``score``).

    ``score`` is an aggregate over the component's cells; ties go to the smaller root.
    """
    value = score if score is not None else F.count(F.lit(1)).cast("double")
    per = labelled.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("area"), value.alias("score")).where(F.col("area") >= min_area)
    best = per.groupBy(*keys).agg(F.max_by(F.struct("root", "area", "score"), F.struct("score", -F.col("root"))).alias("_b")).select(*keys, "_b.*")
    return labelled.join(best, [*keys, "root"])


def signed_distance(voxels: DataFrame, keys: Sequence[str], resolution: Column | float = 1.0, truncate: bool = False) -> DataFrame:
    """Euclidean distance to the nearest opposite voxel, negative inside.

    The squared distance separates by axis: one pass handles x and y for slabs of a few planes, a
    second one handles z for bundles of 16 x 16 columns. Both kinds of group are bounded by the
    grid's axes and never hold a whole grid. NULL where a grid has no opposite voxel. ``truncate`` clips to two voxels; if only
    that is wanted, :func:`truncated_distance` reads no more than the neighbourhood.
    """
    keys = list(keys)
    key_types, nk = types_of(voxels, keys), len(keys)
    far, low = 1e12, (1 << SIDE) - 1
    index = lambda c, size: F.floor(F.col(c) / size).cast("long")

    def slab(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, row, codes in slices(whole, nk + 1):
                (code,) = codes
                occ, iy, ix = (code & 1).astype(bool), code >> 1 & low, code >> 1 + SIDE & low
                iz = b.columns[nk].to_numpy()[row] * SLAB + (code >> 1 + 2 * SIDE)
                _, first, plane = np.unique(row * SLAB + iz % SLAB, return_index=True, return_inverse=True)
                nx, ny = np.zeros((2, b.num_rows), np.int64)
                np.maximum.at(nx, row, ix + 1)
                np.maximum.at(ny, row, iy + 1)
                nx, ny = nx[row[first]], ny[row[first]]  # of each plane; a slab's planes have one size
                start = np.cumsum([0, *(nx * ny)])
                at, dense = start[plane] + ix * ny[plane] + iy, np.zeros(start[-1], bool)
                dense[at] = occ
                lines = []
                for count, step, other, length in ((ny, ny, 1, nx), (nx, 1, ny, ny)):
                    of = np.repeat(np.arange(len(nx)), count)
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    lines.append((start[of] + nth * np.broadcast_to(other, len(nx))[of], np.broadcast_to(step, len(nx))[of], length[of]))
                f = []
                for mask in (dense, ~dense):
                    g = np.where(mask, 0.0, far)
                    for line in lines:
                        g = numerics.line_pass(g, *line, far)
                    f.append(g[at])
                # On to the second pass in packs of 16 x 16 columns, a row each.
                bundle = np.stack([row, ix >> 4, iy >> 4])
                order = np.lexsort(bundle[::-1])
                bundle = bundle[:, order]
                cuts = np.flatnonzero(np.r_[True, (bundle[:, 1:] != bundle[:, :-1]).any(0)])
                ends = pa.array(np.r_[cuts, len(order)], pa.int32())
                pack = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (iz << 8 | (ix & 15) << 4 | iy & 15, *f)]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(bundle[0, cuts])) for c in b.columns[:nk]], *[pa.array(v[cuts]) for v in bundle[1:]], *pack], [*keys, "_bx", "_by", "at", "f_occ", "f_emp"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, row, (code, *f) in slices(whole, nk + 2):
                iz, (_, line) = code >> 8, np.unique(row << 8 | code & 255, return_inverse=True)
                length = np.zeros(line.max(initial=-1) + 1, np.int64)
                np.maximum.at(length, line, iz + 1)
                start = np.cumsum([0, *length])
                out = []
                for v in f:
                    g = np.full(start[-1], far)
                    g[start[line] + iz] = v
                    out.append(numerics.line_pass(g, start[:-1], np.ones_like(length), length, far)[start[line] + iz])
                ix, iy = (b.columns[nk + i].to_numpy()[row] * 16 + v for i, v in enumerate((code >> 4 & 15, code & 15)))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in b.columns[:nk]], *[pa.array(v.astype(np.int32)) for v in (ix, iy, iz)], *map(pa.array, out)], [*keys, *VOXEL, "f_occ", "f_emp"])

    code = F.shiftleft(packed(F.col("iz") % SLAB, F.col("ix"), F.col("iy")), 1).bitwiseOR(F.coalesce("occ", F.lit(False)).cast("long"))
    slabs = voxels.groupBy(*keys, index("iz", SLAB).alias("_slab")).agg(F.collect_list(code).alias("code"))
    first = slabs.mapInArrow(slab, f"{key_types}, _bx long, _by long, at array<long>, f_occ array<double>, f_emp array<double>")
    parts = ("at", "f_occ", "f_emp")
    second = first.groupBy(*keys, "_bx", "_by").agg(F.collect_list(F.struct(*parts)).alias("p")).select(
        *keys, "_bx", "_by", *[F.flatten(F.col("p")[c]).alias(c) for c in parts]).mapInArrow(strip, f"{key_types}, ix int, iy int, iz int, f_occ double, f_emp double")
    res = resolution if isinstance(resolution, Column) else F.lit(float(resolution))
    d = (F.sqrt("f_occ") - F.sqrt("f_emp")) * res
    d = F.when((F.col("f_occ") < far / 2) & (F.col("f_emp") < far / 2), d)
    if truncate:
        d = F.greatest(-2 * res, F.least(2 * res, d))
    return second.withColumn("sdf", d).drop("f_occ", "f_emp")


def truncated_distance(voxels: DataFrame, keys: Sequence[str], resolution: Column | float = 1.0, reach: int = 2, edge: int = 16) -> DataFrame:
    """Signed distance clipped to ``reach`` voxels, as ``tsdf``, with ``occ``.

    What lies farther away does not matter, so a tile of ``edge`` voxels per axis needs no more than ``reach`` voxels of its
    neighbours; a voxel is sent to the tiles it is that close to, and no group spans an axis of the grid.
    """
    keys, place, side = list(keys), ("tx", "ty", "tz"), edge + 2 * reach
    near = lambda c: F.array_compact(F.array(F.lit(0), F.when(F.col(c) % edge < reach, F.lit(-1)), F.when(F.col(c) % edge >= edge - reach, F.lit(1))))
    s = voxels.select(*keys, *VOXEL, "occ")
    for c, t in zip(VOXEL, place):
        s = s.withColumn(t, F.explode(F.transform(near(c), lambda o: (F.floor(F.col(c) / edge) + o).cast("int"))))
    x, y, z = (F.col(c) - F.col(t) * edge + reach for c, t in zip(VOXEL, place))
    tiles = s.where("tx >= 0 AND ty >= 0 AND tz >= 0").groupBy(*keys, *place).agg(F.collect_list(F.struct(((x * side + y) * side + z).cast("int").alias("at"), "occ")).alias("voxels"))
    steps = sorted((a * a + b * b + c * c, a, b, c) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) for c in range(-reach, reach + 1))
    nk, own = len(keys), slice(reach, reach + edge)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, occ = (f.to_numpy(zero_copy_only=False) for f in b.columns[nk + 3][r].values.flatten())
                here = np.full((side,) * 3, -1, np.int8)
                here.reshape(-1)[at] = occ
                d = np.full((edge,) * 3, float(reach))
                mine, open_ = here[own, own, own], np.full((edge,) * 3, True)
                for square, i, j, k in steps:
                    if 0 < square <= reach * reach:
                        other = here[reach + i : reach + i + edge, reach + j : reach + j + edge, reach + k : reach + k + edge]
                        hit = open_ & (other >= 0) & (other != mine)
                        d[hit] = np.sqrt(square)
                        open_ &= ~hit
                index = np.argwhere(mine >= 0)
                if len(index):
                    corner = [b.columns[nk + i][r].as_py() * edge for i in range(3)]
                    inside = mine[tuple(index.T)] == 1
                    signed = d[tuple(index.T)] * np.where(inside, -1, 1)
                    yield pa.RecordBatch.from_arrays([*[repeated(c, r, len(index)) for c in b.columns[:nk]], *[pa.array((index[:, i] + corner[i]).astype(np.int32)) for i in range(3)], pa.array(inside), pa.array(signed)],
                                                     [*keys, *VOXEL, "occ", "tsdf"])

    res = resolution if isinstance(resolution, Column) else F.lit(float(resolution))
    return tiles.mapInArrow(distances, types_of(tiles, keys) + ", ix int, iy int, iz int, occ boolean, tsdf double").withColumn("tsdf", F.col("tsdf") * res)
