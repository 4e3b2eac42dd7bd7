"""Placement of voxel distributions in a target: pose scoring and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..session import cut
from .grid import VOXEL
from .skew import broadcast_if_small, spread

# Fitness weights and scale, and the result for an empty distribution.
W_LEAK, W_CENTRE, W_DEPTH, SCALE = 0.15, 0.02, 0.05, 1000.0
EMPTY_FITNESS = 1e6
EPS = 2.220446049250313e-16
# A voxel row is four integers: at most about 40 MB.
MASK_BROADCAST_ROWS = 1_000_000


def accessible(points: DataFrame, keys: Sequence[str], z_access: Column, resolution: Column | float) -> DataFrame:
    """interior points near or above the access height; all of a target's points if none is."""
    near = F.col("z") >= z_access - 2 * resolution
    any_ = points.groupBy(*keys).agg(F.max(near).alias("_any"))
    return points.join(any_, list(keys)).where(~F.col("_any") | near).drop("_any")


def rotated_box(box: Sequence[tuple[Column, Column]], m: list[list[Column]], shift: G.Vec) -> list[tuple[Column, Column]]:
    """world extents of a turned and moved local box.

    Each world coordinate is a sum of three independent terms, so its extremes are the sums of
    the terms' extremes; no corner has to be built.
    """
    out = []
    for row, t in zip(m, shift):
        lo, hi = t, t
        for k, (a, b) in zip(row, box):
            lo, hi = lo + F.least(k * a, k * b), hi + F.greatest(k * a, k * b)
        out.append((lo, hi))
    return out


def _boxes(poses: DataFrame, shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """Poses with their rotation ``_m``, and the first (``_a``), last (``_b``) and number (``_c``) of target-grid positions of their box per axis."""
    p = poses.join(shapes, "dist_id").join(frames, "target_id")
    angles = G.axis_angles(F.col("a1"), F.col("a2"), F.col("axis1"), F.col("axis2"))
    p = p.withColumns({f"_t{i}": a for i, a in enumerate(angles)})
    p = p.withColumns({f"_{n}{i}": f(F.col(f"_t{i}")) for i in range(3) for n, f in (("cos", F.cos), ("sin", F.sin))})
    m = G.rotation_of([F.col(f"_cos{i}") for i in range(3)], [F.col(f"_sin{i}") for i in range(3)])
    p = p.withColumns({f"_m{i}{j}": m[i][j] for i in range(3) for j in range(3)})
    box = [(F.col(f"{a}0"), F.col(f"{a}0") + F.col(f"d{a}") * (F.col(f"n{a}") - 1)) for a in "xyz"]
    ends = {}
    for a, (lo, hi) in zip("xyz", rotated_box(box, _matrix(), _shift())):
        ends[f"_a{a}"] = F.greatest(F.lit(0), F.ceil((lo - F.col(f"g{a}0")) / F.col("gstep") - 1e-9)).cast("int")
        ends[f"_b{a}"] = F.least(F.col(f"g{a}n") - 1, F.floor((hi - F.col(f"g{a}0")) / F.col("gstep") + 1e-9)).cast("int")
    p = p.withColumns(ends).withColumns({f"_c{a}": F.greatest(F.lit(0), F.col(f"_b{a}") - F.col(f"_a{a}") + 1) for a in "xyz"})
    # Written once: otherwise the optimiser copies these terms into every filter on them, and the code outgrows a compiled method.
    return cut(spread(p, "pose_id"))


def _matrix() -> list[list[Column]]:
    return [[F.col(f"_m{i}{j}") for j in range(3)] for i in range(3)]


def _shift() -> G.Vec:
    return F.col("px"), F.col("py"), F.col("pz")


def summed_volume(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """(target_id, gx, gy, gz, below): occupied target voxels at or before every grid position, along all axes."""
    g = frames.select("target_id", "gxn", "gyn", "gzn")
    for a in "xyz":
        g = g.withColumn(f"g{a}", F.explode(F.sequence(F.lit(0), F.col(f"g{a}n") - 1)))
        g = spread(g, "target_id", "gx") if a == "x" else g
    g = g.drop("gxn", "gyn", "gzn").join(targets.select("target_id", "gx", "gy", "gz", F.lit(1).alias("_t")).distinct(), ["target_id", "gx", "gy", "gz"], "left")
    total = F.coalesce("_t", F.lit(0))
    for a, rest in (("gx", ("gy", "gz")), ("gy", ("gx", "gz")), ("gz", ("gx", "gy"))):
        g = g.withColumn("below", F.sum(total).over(Window.partitionBy("target_id", *rest).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)))
        total = F.col("below")
    return g.select("target_id", "gx", "gy", "gz", "below")


def pose_bounds(poses: DataFrame, shapes: DataFrame, sums: DataFrame, frames: DataFrame, summary: DataFrame, resolution: float) -> DataFrame:
    """What no pose can beat, without expanding it: ``n_most`` target voxels in its box, ``n_points`` of the box, ``fitness_least``.

    A pose covers at most the target voxels of its upright box, which is eight look-ups in the summed volumes; its distance
    and depth terms are exact, and no leak is assumed. So a pose whose ``fitness_least`` is above a known fitness cannot win.
    """
    p = _boxes(poses, shapes, frames)
    corner = F.explode(F.array(*[F.struct(F.lit((-1) ** (i + j + k)).alias("sign"), *[(F.col(f"_a{a}") - 1 if low else F.col(f"_b{a}")).alias(f"g{a}") for a, low in zip("xyz", (i, j, k))])
                                 for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    full = (F.col("_cx") > 0) & (F.col("_cy") > 0) & (F.col("_cz") > 0)
    at = p.where(full).select("pose_id", "target_id", corner.alias("c")).select("pose_id", "target_id", "c.*").where("gx >= 0 AND gy >= 0 AND gz >= 0")
    most = at.join(broadcast_if_small(cut(sums), MASK_BROADCAST_ROWS), ["target_id", "gx", "gy", "gz"]).groupBy("pose_id").agg(F.sum(F.col("sign") * F.col("below")).alias("n_most"))
    points = F.when(full, F.col("_cx").cast("long") * F.col("_cy") * F.col("_cz")).otherwise(F.lit(0))
    j = p.select(*poses.columns, points.alias("n_points")).join(most, "pose_id", "left").fillna(0, ["n_most"]).join(summary, "target_id")
    v, n = resolution**3, F.least("n_most", "n_target")
    least = fitness_columns(n * v, F.greatest(n, F.lit(1)) * v, F.col("n_target") * v, _shift(), (F.col("cx"), F.col("cy"), F.col("cz")), F.col("extent"), F.col("z_access"))["fitness"]
    return j.select(*poses.columns, "n_points", "n_most", (least - 1e-9).alias("fitness_least"))


def mask_words(distributions: DataFrame, shapes: DataFrame) -> DataFrame:
    """(dist_id, _layer, _sx, _sy, _words): a distribution's occupied voxels as bits, 64 to a number, in the order of x, y, z within its box.

    A pose's box holds its whole distribution, so a mask is at most a 64th of the points the pose must look at. Voxels
    outside the grid are met by no point. A voxel that comes n times has a bit in n layers.
    """
    box = shapes.groupBy("dist_id").agg(*[F.max(F.ceil(f"n{a}")).cast("long").alias(f"_s{a}") for a in "xyz"])
    d = distributions.select("dist_id", *VOXEL).withColumn("_layer", F.row_number().over(Window.partitionBy("dist_id", *VOXEL).orderBy(F.lit(1))))
    d = d.join(box, "dist_id").where(" AND ".join(f"i{a} BETWEEN 0 AND _s{a} - 1" for a in "xyz"))
    d = d.withColumn("_at", (F.col("iz") * F.col("_sy") + F.col("iy")) * F.col("_sx") + F.col("ix"))
    keys = ["dist_id", "_layer", "_sx", "_sy", "_sz"]
    words = d.groupBy(*keys, F.expr("_at div 64").alias("_i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 AS int))")).alias("_bits"))
    every = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_bits"))).alias("_held"))
    # Words without a voxel are zero, so that a word is found by its number.
    gaps = F.expr("""flatten(transform(_held, (w, k) -> concat(
        array_repeat(0L, cast(w._i - if(k = 0, -1L, _held[k - 1]._i) - 1 AS int)), array(w._bits))))""")
    return every.select("dist_id", "_layer", "_sx", "_sy", gaps.alias("_words"))


def pose_counts(poses: DataFrame, distributions: DataFrame, shapes: DataFrame, targets: DataFrame, frames: DataFrame) -> DataFrame:
    """C22, counting part: per pose the target-grid points inside the distribution, and of those in the target.

    * ``poses``: pose_id, dist_id, target_id, px, py, pz, a1, a2, axis1, axis2
    * ``distributions``: dist_id, ix, iy, iz of occupied voxels; ``shapes``: their grids
    * ``targets``: target_id, gx, gy, gz of occupied target voxels
    * ``frames``: target_id, g{x,y,z}0 origin, gstep, g{x,y,z}n length of the target grid

    Each pose expands only into the grid points of its own rotated box, which are the points that
    must be evaluated. The distribution's voxels come along with the pose as bits, so no grid point outside it is joined or
    moved; those inside meet the target's voxels by an equi-join, broadcast while that table is counted to be small.
    """
    p, m, shift = _boxes(poses, shapes, frames), _matrix(), _shift()
    p = p.join(broadcast_if_small(cut(mask_words(distributions, shapes)), MASK_BROADCAST_ROWS), "dist_id")
    # Only what a grid point needs rides through the expansion: first the lines of the box, then the points of each line.
    p = p.where("_cx > 0 AND _cy > 0 AND _cz > 0").select(
        "pose_id", "target_id", "px", "py", "pz", *[f"_m{i}{j}" for i in range(3) for j in range(3)], "gstep", "_sx", "_sy", "_words",
        *[f"{n}{a}" for a in "xyz" for n in ("d", "n", "_a", "_b")], *[f"{a}0" for a in "xyz"], *[f"g{a}0" for a in "xyz"], "_cy",
        F.explode(F.expr("sequence(0L, cast(_cy AS bigint) * _cz - 1)")).alias("_line"))
    p = p.withColumns({"gy": (F.col("_ay") + F.col("_line") % F.col("_cy")).cast("int"), "gz": (F.col("_az") + F.expr("_line div _cy")).cast("int")}).drop("_line", "_cy")
    p = p.withColumn("gx", F.explode(F.sequence("_ax", "_bx")))
    world = tuple(F.col(f"g{a}0") + F.col(f"g{a}") * F.col("gstep") for a in "xyz")
    local = G.to_local(world, m, shift)
    out = F.lit(False)
    for a, v in zip("xyz", local):
        u = (v - F.col(f"{a}0")) / F.col(f"d{a}")
        out = out | (u < 0) | (u > F.col(f"n{a}") - 1)
        p = p.withColumn(f"i{a}", F.floor(u + 0.5).cast("int"))
    goal = broadcast_if_small(cut(targets.select("target_id", "gx", "gy", "gz", F.lit(1).alias("_t"))), MASK_BROADCAST_ROWS)
    at = p.where(~out).withColumn("_at", (F.col("iz") * F.col("_sy") + F.col("iy")) * F.col("_sx") + F.col("ix"))
    inside = at.where("shiftrightunsigned(get(_words, cast(_at div 64 AS int)), cast(_at % 64 AS int)) & 1L = 1L").select("pose_id", "target_id", "gx", "gy", "gz")
    marked = inside.join(goal, ["target_id", "gx", "gy", "gz"], "left")
    counts = marked.groupBy("pose_id").agg(F.count(F.lit(1)).alias("n_dist"), F.count("_t").alias("n_in"))
    return poses.join(counts, "pose_id", "left").fillna(0, ["n_dist", "n_in"])


def fitness_columns(v_in: Column, v_dist: Column, v_target: Column, centre: G.Vec, target_centre: G.Vec,
                    extent: Column, z_access: Column) -> dict[str, Column]:
    """Coverage, leak, normalised distance and depth, and the fitness (smaller is better)."""
    empty = F.coalesce(v_dist <= 0, F.lit(True))
    scale = F.greatest(extent, F.lit(EPS))
    coverage = v_in / F.greatest(v_target, F.lit(EPS))
    leak = (v_dist - v_in) / F.greatest(v_dist, F.lit(EPS))
    off = F.sqrt(G.distance2(centre, target_centre)) / scale
    deep = F.coalesce(F.greatest(F.lit(0.0), z_access - centre[2]) / scale, F.lit(0.0))
    value = SCALE * (-coverage + W_LEAK * leak + W_CENTRE * off * off + W_DEPTH * deep * deep)
    pick = lambda instead, c: F.when(empty, F.lit(float(instead))).otherwise(c)
    return {"fitness": pick(EMPTY_FITNESS, value), "coverage": pick(0, coverage), "leak": pick(1, leak),
            "centre_distance": pick(1, off), "depth": pick(1, deep)}


def scored(counts: DataFrame, targets: DataFrame, resolution: float) -> DataFrame:
    """Volumes and fitness of counted poses.

    ``targets`` holds target_id, n_target, cx, cy, cz, extent, z_access. The distribution centre
    of a pose is its translation.
    """
    v = resolution**3
    j = counts.join(targets, "target_id")
    cols = fitness_columns(F.col("n_in") * v, F.col("n_dist") * v, F.col("n_target") * v, (F.col("px"), F.col("py"), F.col("pz")),
                           (F.col("cx"), F.col("cy"), F.col("cz")), F.col("extent"), F.col("z_access"))
    return j.withColumns(cols)


def insertion_depth(poses: DataFrame, layout: DataFrame, z_access: Column) -> DataFrame:
    """Base depth plus the depth of antenna 1 below the access height."""
    first = layout.where("antenna = 1").select("antena", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("z").alias("lz"))
    j = poses.join(broadcast_if_small(first, MASK_BROADCAST_ROWS), "antena")
    m = G.rotation(G.axis_angles(F.col("a1"), F.col("a2"), F.col("axis1"), F.col("axis2")))
    at = G.to_world((F.col("lx"), F.col("ly"), F.col("lz")), m, (F.col("px"), F.col("py"), F.col("pz")))
    inner = F.coalesce(F.greatest(F.lit(0.0), z_access - at[2]), F.lit(0.0))
    return j.withColumns({"depth_mesh_mm": inner, "depth_total_mm": inner + G.BASE_DEPTH_MM}).drop("lx", "ly", "lz")
