"""Triangle meshes: vertex tables, containment, nearest facets, smoothing, subdivision, surfaces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut
from . import octree
from .field import bounding_box
from .grid import TILE, VOXEL, step_grid
from .octree import nearest
from .packs import repeated, slices, types_of
from .skew import ranked

MESH = "mesh_id"
# Vertices of a patch and steps done inside patches before coordinates travel again.
PATCH, RINGS = 4096, 4


def corner_rows(facets: DataFrame) -> DataFrame:
    """Three rows per facet: (mesh, facet, corner 0..2, x, y, z)."""
    return facets.select(MESH, "facet_id", F.posexplode(F.array("v1", "v2", "v3")).alias("corner", "v")).select(
        MESH, "facet_id", "corner", "v.x", "v.y", "v.z")


def index_vertices(facets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vertices numbered by first appearance, and facets as vertex numbers (from 1)."""
    c = corner_rows(facets).withColumn("pos", F.col("facet_id") * 3 + F.col("corner"))
    first = c.groupBy(MESH, "x", "y", "z").agg(F.min("pos").alias("pos"))
    vertices = ranked(first, [MESH], "pos", name="vid").drop("pos")
    j = c.join(vertices, [MESH, "x", "y", "z"])
    pick = lambda n: F.max(F.when(F.col("corner") == n, F.col("vid")))
    return vertices, j.groupBy(MESH, "facet_id").agg(pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("c"))


def with_corners(indexed: DataFrame, vertices: DataFrame) -> DataFrame:
    """Facets with coordinates again."""
    out = indexed
    for name, v in zip("abc", ("v1", "v2", "v3")):
        side = vertices.select(MESH, F.col("vid").alias(name), F.struct("x", "y", "z").alias(v))
        out = out.join(side, [MESH, name])
    return out.select(MESH, "facet_id", "v1", "v2", "v3")


def shift_vertices(vertices: DataFrame, to: str = "rest") -> DataFrame:
    """``rest`` subtracts mean x, mean y and lowest z; ``centroid`` subtracts the mean."""
    low = F.min("z") if to == "rest" else F.avg("z")
    m = vertices.groupBy(MESH).agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"), low.alias("_z"))
    return vertices.join(m, MESH).withColumns({a: F.col(a) - F.col(f"_{a}") for a in "xyz"}).drop("_x", "_y", "_z")


def facet_frames(facets: DataFrame) -> DataFrame:
    """Centroid and unit normal of every facet, turned outward from the mean facet centroid."""
    v = [G.point(n) for n in ("v1", "v2", "v3")]
    c, n = G.facet_centroid(*v), G.facet_normal(*v)
    f = facets.select(MESH, "facet_id", G.xyz_struct(c).alias("c"), G.xyz_struct(n).alias("n"))
    mid = f.groupBy(MESH).agg(*[F.avg(f"c.{a}").alias(f"_{a}") for a in "xyz"])
    j = f.join(mid, MESH)
    out = G.outward(G.point("n"), G.point("c"), (F.col("_x"), F.col("_y"), F.col("_z")))
    return j.select(MESH, "facet_id", *[F.col(f"c.{a}").alias(f"c{a}") for a in "xyz"], *[o.alias(f"n{a}") for a, o in zip("xyz", out)])


def nearest_facet(queries: DataFrame, facets: DataFrame, qid: str) -> DataFrame:
    """The facet with the nearest centroid, with its normal."""
    frames = facet_frames(facets)
    c = frames.select(MESH, "facet_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return nearest(queries, c, [MESH], qid, "facet_id").join(frames, [MESH, "facet_id"]).drop("rn")


def best_node(candidates: DataFrame, keys: Sequence[str], qid: str) -> DataFrame:
    """Of the (at most 250) nearest nodes the one with most finite instants, then the nearest."""
    rank = F.struct(F.col("n_finite"), -F.col("distance"), -F.col("rn"))
    rest = [c for c in candidates.columns if c not in (*keys, qid)]
    return candidates.where("n_finite > 0").groupBy(*keys, qid).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, qid, "_r.*")


def nearest_finite(queries: DataFrame, nodes: DataFrame, keys: Sequence[str], qid: str, pid: str, k: int = 250) -> DataFrame:
    """``best_node`` of the ``k`` nearest nodes (with their ``n_finite``); queries that have no finite node among these
    get the best of the ``k`` nearest finite nodes. Queries without a place have none."""
    keys = list(keys)
    finite = nodes.where("n_finite > 0")
    search = lambda q, n: best_node(nearest(q, n, keys, qid, pid, k).join(finite.select(*keys, pid, "n_finite"), [*keys, pid]), keys, qid)
    found = cut(search(queries, nodes))
    rest = cut(queries.join(found.select(*keys, qid), [*keys, qid], "left_anti"))
    return found if rest.isEmpty() else found.unionByName(search(rest, finite))


def ray_crossings(points: DataFrame, facets: DataFrame, cells_per_axis: int = 15, flip_normals: bool = False) -> DataFrame:
    """Heights at which the vertical line through each distinct (x, y) meets the mesh.

    Facets are hashed into square columns of the mesh's footprint (finer for meshes with many
    facets) and joined to rays by column, so a ray only meets facets above its own column.
    Vertical facets are ignored. One row per ray: an array of (height, side), side +1 when the
    outward normal points up; its length is the number of pierced facets.
    """
    v = [G.point(n) for n in ("v1", "v2", "v3")]
    n = G.cross(G.sub(v[1], v[0]), G.sub(v[2], v[0]))
    f = facets.select(MESH, "v1", "v2", "v3", n[2].alias("nz"), (G.norm(n)).alias("len"),
                      *[fn(*[p[i] for p in v]).alias(f"{e}{a}") for i, a in ((0, "x"), (1, "y")) for e, fn in (("lo", F.least), ("hi", F.greatest))])
    foot = f.groupBy(MESH).agg(F.min("lox").alias("x0"), F.max("hix").alias("x1"), F.min("loy").alias("y0"), F.max("hiy").alias("y1"),
                               F.greatest(F.lit(cells_per_axis), F.ceil(F.sqrt(F.count(F.lit(1)) / 8))).alias("m"))
    eps = 1e-9
    at = lambda c, a: F.floor((c - F.col(f"{a}0")) / F.greatest(F.col(f"{a}1") - F.col(f"{a}0"), F.lit(eps)) * F.col("m")).cast("int")
    f = f.where(F.abs(F.col("nz")) > 1e-12 * F.col("len")).join(foot, MESH)
    spread = f.withColumn("gx", F.explode(F.sequence(at(F.col("lox") - eps, "x"), at(F.col("hix") + eps, "x")))) \
        .withColumn("gy", F.explode(F.sequence(at(F.col("loy") - eps, "y"), at(F.col("hiy") + eps, "y"))))
    rays = points.select(MESH, "x", "y").distinct().join(foot, MESH).where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1") \
        .withColumns({"gx": at(F.col("x"), "x"), "gy": at(F.col("y"), "y")}).select(MESH, "x", "y", "gx", "gy")
    j = rays.join(spread.select(MESH, "gx", "gy", "v1", "v2", "v3", "nz"), [MESH, "gx", "gy"])
    x, y = F.col("x"), F.col("y")
    # Barycentric weights in the footprint plane; the border counts as hit.
    w2 = ((x - v[0][0]) * (v[2][1] - v[0][1]) - (v[2][0] - v[0][0]) * (y - v[0][1])) / F.col("nz")
    w3 = ((v[1][0] - v[0][0]) * (y - v[0][1]) - (x - v[0][0]) * (v[1][1] - v[0][1])) / F.col("nz")
    hit = j.withColumns({"w2": w2, "w3": w3}).where((F.col("w2") >= -eps) & (F.col("w3") >= -eps) & (F.col("w2") + F.col("w3") <= 1 + eps))
    height = v[0][2] + F.col("w2") * (v[1][2] - v[0][2]) + F.col("w3") * (v[2][2] - v[0][2])
    side = F.when(F.col("nz") > 0, 1.0).otherwise(-1.0) * (-1.0 if flip_normals else 1.0)
    return hit.groupBy(MESH, "x", "y").agg(F.collect_list(F.struct(height.alias("h"), side.alias("s"))).alias("hits"))


def inside_mesh(points: DataFrame, facets: DataFrame, tol: float = 0.0, cells_per_axis: int = 15, flip_normals: bool = False) -> DataFrame:
    """Adds ``inside``: the nearest pierced facet(s) lie on the outer side of the point.

    The signed vertical distance to a facet is negative below an up-facing and above a
    down-facing one. Distances of facets tied for nearest are added.
    """
    rays = ray_crossings(points, facets, cells_per_axis, flip_normals)
    j = points.join(rays, [MESH, "x", "y"], "left")
    signed = F.transform("hits", lambda h: h["s"] * (F.col("z") - h["h"]))
    j = j.withColumn("_d", signed).withColumn("_m", F.array_min(F.transform("_d", F.abs)))
    total = F.aggregate(F.filter("_d", lambda d: F.abs(d) <= F.col("_m")), F.lit(0.0), lambda a, d: a + d)
    return j.withColumn("inside", F.coalesce(total < tol, F.lit(False))).drop("hits", "_d", "_m")


def box_of(facets: DataFrame) -> DataFrame:
    return bounding_box(corner_rows(facets), [MESH])


def centred_facets(facets: DataFrame) -> DataFrame:
    """Facets moved so that the mean of the distinct vertices is the origin."""
    c = corner_rows(facets).select(MESH, "x", "y", "z").distinct()
    m = c.groupBy(MESH).agg(*[F.avg(a).alias(f"_{a}") for a in "xyz"])
    move = lambda v: F.struct(*[(F.col(f"{v}.{a}") - F.col(f"_{a}")).alias(a) for a in "xyz"])
    return facets.join(m, MESH).select(MESH, "facet_id", *[move(v).alias(v) for v in ("v1", "v2", "v3")])


def mesh_volume(facets: DataFrame, resolution: float = 1.5) -> DataFrame:
    """Inside count of a centred grid times the voxel volume."""
    f = centred_facets(facets)
    grid = step_grid(box_of(f), resolution)
    return inside_mesh(grid, f).groupBy(MESH).agg((F.count_if("inside") * resolution**3).alias("volume"))


def voxelised(facets: DataFrame, resolution: float = 0.5) -> DataFrame:
    """C20: occupancy of a grid one voxel wider than the centred mesh on every side."""
    f = centred_facets(facets)
    return inside_mesh(step_grid(box_of(f), resolution, resolution), f).withColumnRenamed("inside", "occ")


def adjacency(indexed: DataFrame) -> DataFrame:
    """Distinct (vertex, neighbour) pairs of all facet edges, both directions."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a")]
    both = [F.struct(F.col(p).alias("vid"), F.col(q).alias("nb")) for p, q in pairs + [(q, p) for p, q in pairs]]
    return indexed.select(MESH, F.explode(F.array(*both)).alias("e")).select(MESH, "e.*").where("vid != nb").distinct()


def patches(adj: DataFrame, vertices: DataFrame, rings: int, size: int = PATCH) -> DataFrame:
    """One row per patch of neighbouring vertices: (mesh, _patch, own, edges) with everything ``rings`` steps of smoothing need.

    Patches are the tiles of an octree over the vertices (``size`` of them at most). ``edges`` lists (vid, nb) of the patch's vertices and of those
    fewer than ``rings`` edges away; ``own`` lists the patch's vertices. The rings are found once, by as many joins.
    """
    placed = octree.placed(vertices)
    cells = octree.tiled(octree.coded(placed.join(octree.extents(placed, [MESH], size), MESH)), [MESH], pid="vid")
    home = cells.select(MESH, "vid", F.concat_ws("_", F.col("_tile").cast("string"), F.col("_part").cast("string")).alias("_patch"))
    near = cut(vertices.select(MESH, "vid").join(home, [MESH, "vid"], "left").select(MESH, F.coalesce("_patch", F.lit("none")).alias("_patch"), "vid", F.lit(0).alias("_ring")))
    own, reached = near, near
    for ring in range(1, rings):
        step = reached.join(adj, [MESH, "vid"]).select(MESH, "_patch", F.col("nb").alias("vid"), F.lit(ring).alias("_ring"))
        seen = cut(near.unionByName(step).groupBy(MESH, "_patch", "vid").agg(F.min("_ring").alias("_ring")))
        near, reached = seen, seen.where(F.col("_ring") == ring)
    edges = near.join(adj, [MESH, "vid"]).groupBy(MESH, "_patch").agg(F.collect_list(F.struct("vid", "nb")).alias("edges"))
    mine = own.groupBy(MESH, "_patch").agg(F.collect_list("vid").alias("own"))
    return mine.join(edges, [MESH, "_patch"], "left")


def smoothed(indexed: DataFrame, vertices: DataFrame, steps: Sequence[float], rings: int = RINGS, size: int = PATCH) -> DataFrame:
    """Each step moves every vertex by a factor of the way to its neighbours' mean.

    Laplacian smoothing is ``[1.0] * n``; Taubin smoothing alternates its two factors. ``rings`` steps are done at a time, inside patches
    that know the vertices up to ``rings`` edges away, so coordinates travel once for that many steps.
    """
    adj = cut(adjacency(indexed))
    v = cut(vertices.select(MESH, "vid", "x", "y", "z"))
    rings = max(1, min(rings, len(steps)))
    known = cut(patches(adj, v, rings, size))
    ends = F.explode(F.array_distinct(F.concat("own", F.coalesce(F.transform("edges", lambda e: e["nb"]), F.array().cast("array<long>")))))
    members = cut(known.select(MESH, "_patch", ends.alias("vid")))
    shape = f"{MESH} {vertices.schema[MESH].dataType.simpleString()}, vid long, x double, y double, z double"
    for at in range(0, len(steps), rings):
        part = list(steps[at : at + rings])

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    mesh, own, edges, points = b.columns
                    vid, *xyz = (f.to_numpy(zero_copy_only=False) for f in points[r].values.flatten())
                    order = np.argsort(vid)
                    vid, p = vid[order], np.stack(xyz, 1)[order].astype(float)
                    if edges[r].is_valid:
                        a, nb = (np.searchsorted(vid, f.to_numpy(zero_copy_only=False)) for f in edges[r].values.flatten())
                        degree = np.bincount(a, minlength=len(vid))[:, None]
                        for k in part:
                            mean = np.stack([np.bincount(a, p[nb, i], len(vid)) for i in range(3)], 1) / np.maximum(degree, 1)
                            p = np.where(degree > 0, p + k * (mean - p), p)
                    ids = own[r].values
                    q = p[np.searchsorted(vid, ids.to_numpy(zero_copy_only=False))]
                    yield pa.RecordBatch.from_arrays([repeated(mesh, r, len(ids)), ids, *[pa.array(q[:, i]) for i in range(3)]], [MESH, "vid", "x", "y", "z"])

        points = members.join(v, [MESH, "vid"]).groupBy(MESH, "_patch").agg(F.collect_list(F.struct("vid", "x", "y", "z")).alias("points"))
        v = cut(known.join(points, [MESH, "_patch"]).select(MESH, "own", "edges", "points").mapInArrow(move, shape))
    return v


def laplacian(indexed: DataFrame, vertices: DataFrame, rounds: int) -> DataFrame:
    """C17."""
    return smoothed(indexed, vertices, [1.0] * rounds)


def taubin(indexed: DataFrame, vertices: DataFrame, rounds: int, lam: float, mu: float) -> DataFrame:
    """C18."""
    return smoothed(indexed, vertices, [lam, mu] * rounds)


def subdivided(indexed: DataFrame, vertices: DataFrame, levels: int = 1) -> tuple[DataFrame, DataFrame]:
    """Every facet into four; the midpoint of a shared edge exists once, numbered by first use."""
    f, v = indexed, vertices.select(MESH, "vid", "x", "y", "z")
    for level in range(levels):
        ends = [("a", "b"), ("b", "c"), ("c", "a")]
        e = f.select(MESH, "facet_id", F.posexplode(F.array(*[F.struct(
            F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in ends])).alias("side", "e")).select(MESH, "facet_id", "side", "e.*")
        first = e.groupBy(MESH, "lo", "hi").agg(F.min(F.col("facet_id") * 3 + F.col("side")).alias("pos"))
        top = v.groupBy(MESH).agg(F.max("vid").alias("_top"))
        mid = ranked(first, [MESH], "pos", name="_rn").join(top, MESH).withColumn("mid", F.col("_top") + F.col("_rn")).select(MESH, "lo", "hi", "mid")
        if level:
            mid = cut(mid)
        at = lambda n: v.select(MESH, F.col("vid").alias(n), *[F.col(a).alias(f"{n}_{a}") for a in "xyz"])
        new = mid.join(at("lo"), [MESH, "lo"]).join(at("hi"), [MESH, "hi"]).select(
            MESH, F.col("mid").alias("vid"), *[((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2).alias(a) for a in "xyz"])
        side = e.join(mid, [MESH, "lo", "hi"]).groupBy(MESH, "facet_id").agg(
            *[F.max(F.when(F.col("side") == i, F.col("mid"))).alias(f"m{i}") for i in range(3)])
        quad = [("a", "m0", "m2"), ("m0", "b", "m1"), ("m2", "m1", "c"), ("m0", "m1", "m2")]
        f = f.join(side, [MESH, "facet_id"]).select(MESH, "facet_id", F.posexplode(F.array(*[
            F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c")) for p, q, r in quad])).alias("i", "t")).select(
            MESH, (F.col("facet_id") * 4 + F.col("i")).alias("facet_id"), "t.a", "t.b", "t.c")
        v = v.unionByName(new)
    return f, v


# The six faces of a unit cube: direction, then the four corners counter-clockwise seen from outside.
CUBE_FACES = (
    ((-1, 0, 0), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0))),
    ((1, 0, 0), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))),
    ((0, -1, 0), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1))),
    ((0, 1, 0), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0))),
    ((0, 0, -1), ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0))),
    ((0, 0, 1), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))),
)


def voxel_surface(occupied: DataFrame, keys: Sequence[str], size: float = 1.0) -> DataFrame:
    """Closed surface of occupied voxels: faces without a neighbour, two facets each.

    A tile of voxels learns of the voxels across its faces, so a voxel travels little more than once; its bare faces come back as
    bits and become facets by a fixed table. A voxel with a NULL key or coordinate has no neighbours. Facet numbers follow from
    the voxel and the face, so no global counter is needed.
    """
    keys, place, side = list(keys), ("_tx", "_ty", "_tz"), TILE + 2
    nk = len(keys)
    lost = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*keys, *VOXEL)])
    own = occupied.select(*keys, *VOXEL, lost.alias("_lost")).withColumns({
        t: F.when(F.col("_lost"), F.col(c).cast("long")).otherwise(F.floor(F.col(c) / TILE)) for c, t in zip(VOXEL, place)})
    at = {c: F.pmod(F.col(c), F.lit(TILE)) for c in VOXEL}
    across = lambda c, o: [(o if c == v else 0) for v in VOXEL]
    moves = [F.when((at[c] == (0 if o < 0 else TILE - 1)) & ~F.col("_lost"), F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", across(c, o))])) for c in VOXEL for o in (-1, 1)]
    stay = F.struct(*[F.lit(0).alias(n) for n in "abc"])
    sent = own.withColumn("_o", F.explode(F.array_compact(F.array(stay, *moves)))).select(
        *keys, "_lost", *[(F.col(t) + F.col(f"_o.{n}")).alias(t) for t, n in zip(place, "abc")],
        *[(at[c] - F.col(f"_o.{n}") * TILE + 1).cast("long").alias(c) for c, n in zip(VOXEL, "abc")])
    spot = F.when(F.col("_lost"), F.lit(-1)).otherwise((F.col("ix") * side + F.col("iy")) * side + F.col("iz")).cast("int")
    tiles = sent.groupBy(*keys, "_lost", *place).agg(F.collect_list(spot).alias("at"))
    steps = [(d[0] * side + d[1]) * side + d[2] for d, _ in CUBE_FACES]

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, row, (spot,) in slices(whole, nk + 4):
                size = side**3
                code = row * size + spot
                have = np.unique(code[spot >= 0])
                x, y, z = spot // (side * side), spot // side % side, spot % side
                mine = (spot < 0) | (np.minimum(np.minimum(x, y), z) > 0) & (np.maximum(np.maximum(x, y), z) <= TILE)
                row, code, lost = row[mine], code[mine], spot[mine] < 0
                faces = np.where(lost, 63, 0)
                for i, step in enumerate(steps):
                    to = np.searchsorted(have, code + step)
                    faces |= (np.append(have, -1)[to] != code + step).astype(np.int64) << i
                some = faces > 0
                row, lost = row[some], lost[some]
                cells = []
                for tile, v in zip(b.columns[nk + 1 : nk + 4], (x, y, z)):
                    t = tile.take(pa.array(row))
                    cell = t.fill_null(0).to_numpy(zero_copy_only=False)
                    cell = np.where(lost, cell, cell * TILE + v[mine][some] - 1)
                    cells.append(pa.array(cell, mask=t.is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in b.columns[:nk]], *cells, pa.array(faces[some].astype(np.int32))], [*keys, *VOXEL, "faces"])

    found = tiles.mapInArrow(bare, f"{types_of(tiles, keys)}, ix long, iy long, iz long, faces int")
    corner = lambda c: F.struct(*[F.lit(v).alias(a) for a, v in zip("xyz", c)])
    table = [F.struct(F.lit(i).alias("face"), F.lit(half).alias("half"), *[corner(offs[c]).alias(f"v{n}") for n, c in enumerate(picks, start=1)])
             for i, (_, offs) in enumerate(CUBE_FACES) for half, picks in enumerate(((0, 1, 2), (0, 2, 3)))]
    vertex = lambda v: F.struct(*[((F.col(i) + F.col(f"t.{v}.{a}")) * size).cast("double").alias(a) for a, i in zip("xyz", VOXEL)]).alias(v)
    facets = found.withColumn("t", F.explode(F.array(*table))).where(F.expr("getbit(faces, t.face) = 1"))
    return facets.select(*keys, *[F.col(c).cast(occupied.schema[c].dataType).alias(c) for c in VOXEL], "t.face", "t.half", *map(vertex, ("v1", "v2", "v3")))
