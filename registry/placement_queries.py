"""Placement: accessible points, rotated boxes, pose scoring, search and depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.functions import geometry as G
from thermal_lake.operators import placement as P
from thermal_lake.plans import placement_search as PS

from . import standins as S
from .core import R, query, rnd, sub, table, view
from .mesh_queries import _ANG, _rot

# Target = cells of a nation's suppliers on a 25 x 11 x 9 grid; distribution = coarse mask of a supplier. A cell is occupied if its hottest line is.
CELLS = "SELECT CAST(s_nationkey AS INT) AS target_id, CAST(floor((l_quantity - 1) / 2) AS INT) AS gx, CAST(floor(l_discount * 100 + 0.5) AS INT) AS gy, CAST(floor(l_tax * 100 + 0.5) AS INT) AS gz, max(l_extendedprice) > 60000 AS occ FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4"
TARGET = f"SELECT target_id, gx, gy, gz FROM ({CELLS}) c WHERE occ"
VOXELS = "SELECT l_suppkey AS dist_id, CAST(floor((l_quantity - 1) / 10) AS INT) AS ix, CAST(floor(floor(l_discount * 100 + 0.5) / 3) AS INT) AS iy, CAST(floor(floor(l_tax * 100 + 0.5) / 2) AS INT) AS iz, max(l_extendedprice) > 40000 AS occ FROM {lineitem} GROUP BY 1, 2, 3, 4"
DIST = f"SELECT dist_id, ix, iy, iz FROM ({VOXELS}) v WHERE occ"
SHAPE = "SELECT s_suppkey AS dist_id, -2.0E0 AS x0, 1.0E0 AS dx, 5 AS nx, -1.5E0 AS y0, 1.0E0 AS dy, 4 AS ny, -2.0E0 AS z0, 1.0E0 AS dz, 5 AS nz FROM {supplier}"
FRAME = "SELECT CAST(n_nationkey AS INT) AS target_id, 0.0E0 AS gx0, 0.0E0 AS gy0, 0.0E0 AS gz0, 1.0E0 AS gstep, 25 AS gxn, 11 AS gyn, 9 AS gzn FROM {nation}"
POSES = """SELECT o_orderkey AS pose_id, s_suppkey AS dist_id, CAST(o_orderkey % 25 AS INT) AS target_id, o_totalprice / 20000 - 0.0137E0 AS px, o_custkey % 11 + 0.0219E0 AS py, o_orderkey % 9 + 0.0371E0 AS pz,
 (o_orderkey % 31 - 15) / 57.3E0 AS a1, (o_custkey % 12) / 3.83E0 + 0.01E0 AS a2, CAST(o_orderkey % 3 + 1 AS INT) AS axis1, CAST((o_orderkey + 1) % 3 + 1 AS INT) AS axis2
 FROM {orders} JOIN (SELECT s_suppkey, count(*) OVER () AS ns FROM {supplier}) s ON s_suppkey = o_custkey % ns"""
# The same rows for Spark: the number of suppliers is one row, so that suppliers are found by key; a window over all of them and a condition on its count pair every order with every supplier.
POSES_SPARK = POSES.replace("{orders} JOIN (SELECT s_suppkey, count(*) OVER () AS ns FROM {supplier}) s ON s_suppkey = o_custkey % ns",
                            "(SELECT o.*, o_custkey % nullif(ns, 0) AS nth FROM {orders} o CROSS JOIN (SELECT count(*) AS ns FROM {supplier}) n) p JOIN {supplier} s ON s_suppkey = nth")
SUMMARY = f"SELECT target_id, count(*) AS n_target, avg(gx) AS cx, avg(gy) AS cy, avg(gz) AS cz, 25.0E0 AS extent, 9.0E0 AS z_access FROM ({TARGET}) t GROUP BY target_id"


@query("F14_accessible_points", f"""SELECT target_id, gx, gy, z FROM (SELECT *, max(CASE WHEN z >= za - 2 THEN 1 ELSE 0 END) OVER (PARTITION BY target_id) AS hit FROM (SELECT *, CAST(gz AS DOUBLE) AS z, CASE WHEN target_id % 5 = 0 THEN 20.0 ELSE 8.0 END AS za FROM ({sub(TARGET)}) t) q) u WHERE hit = 0 OR z >= za - 2""")
def accessible(spark, d):
    t = view(spark, d, TARGET).withColumn("z", F.col("gz").cast("double"))
    return P.accessible(t, ["target_id"], F.when(F.col("target_id") % 5 == 0, 20.0).otherwise(8.0), 1.0).select("target_id", "gx", "gy", "z")


_CR = _rot(["vx", "vy", "vz"])


@query("F18_rotated_box", f"""WITH c AS (SELECT pose_id, px, py, pz, rx, ry, rz, vx, vy, vz FROM (SELECT *, {_ANG} FROM ({sub(POSES)}) p) p, (VALUES (-2.0, -1.5, -2.0), (-2.0, -1.5, 2.0), (-2.0, 1.5, -2.0), (-2.0, 1.5, 2.0), (2.0, -1.5, -2.0), (2.0, -1.5, 2.0), (2.0, 1.5, -2.0), (2.0, 1.5, 2.0)) v(vx, vy, vz))
SELECT pose_id, {', '.join(f"{R(f'min(p{a} + {e})')} AS lo_{a}, {R(f'max(p{a} + {e})')} AS hi_{a}" for a, e in zip('xyz', _CR))} FROM c GROUP BY 1""")
def rotated_box(spark, d):
    p = view(spark, d, POSES_SPARK)
    m = G.rotation(G.axis_angles(F.col("a1"), F.col("a2"), F.col("axis1"), F.col("axis2")))
    half = [(F.lit(-v), F.lit(v)) for v in (2.0, 1.5, 2.0)]
    box = P.rotated_box(half, m, (F.col("px"), F.col("py"), F.col("pz")))
    return p.select("pose_id", *[rnd(c).alias(f"{e}_{a}") for a, pair in zip("xyz", box) for e, c in zip(("lo", "hi"), pair)])


_LC = _rot(["(gx - px)", "(gy - py)", "(gz - pz)"], True)
_NEAR = f"""SELECT pose_id, dist_id, target_id, gx, gy, gz, CAST(floor({_LC[0]} + 2 + 0.5) AS INT) AS ix, CAST(floor({_LC[1]} + 1.5 + 0.5) AS INT) AS iy, CAST(floor({_LC[2]} + 2 + 0.5) AS INT) AS iz, {_LC[0]} + 2 AS ux, {_LC[1]} + 1.5 AS uy, {_LC[2]} + 2 AS uz
 FROM (SELECT *, {_ANG} FROM ({sub(POSES)}) p0) p, range(-4, 5) a(i), range(-4, 5) b(j), range(-4, 5) c(k), LATERAL (SELECT CAST(round(px) AS INT) + i AS gx, CAST(round(py) AS INT) + j AS gy, CAST(round(pz) AS INT) + k AS gz) g WHERE gx BETWEEN 0 AND 24 AND gy BETWEEN 0 AND 10 AND gz BETWEEN 0 AND 8"""
_CNT = f"""SELECT p.pose_id, p.target_id, p.px, p.py, p.pz, coalesce(n_dist, 0) AS n_dist, coalesce(n_in, 0) AS n_in FROM ({sub(POSES)}) p LEFT JOIN (SELECT q.pose_id, count(*) AS n_dist, count(t.gx) AS n_in FROM ({_NEAR}) q JOIN ({sub(DIST)}) d ON d.dist_id = q.dist_id AND d.ix = q.ix AND d.iy = q.iy AND d.iz = q.iz
 LEFT JOIN ({sub(TARGET)}) t ON t.target_id = q.target_id AND t.gx = q.gx AND t.gy = q.gy AND t.gz = q.gz WHERE ux BETWEEN 0 AND 4 AND uy BETWEEN 0 AND 3 AND uz BETWEEN 0 AND 4 GROUP BY 1) c USING (pose_id)"""


def counts(spark, d):
    return P.pose_counts(view(spark, d, POSES_SPARK), view(spark, d, DIST), view(spark, d, SHAPE), view(spark, d, TARGET), view(spark, d, FRAME))


@query("C22_pose_sweep_scoring", f"SELECT pose_id, n_dist, n_in FROM ({_CNT}) c")
def pose_sweep(spark, d):
    return counts(spark, d).select("pose_id", "n_dist", "n_in")


_OFF = "sqrt((px - cx) ** 2 + (py - cy) ** 2 + (pz - cz) ** 2) / 25"
_DEEP = "greatest(0, 9 - pz) / 25"


@query("A18_placement_fitness", f"""SELECT pose_id, {R('CASE WHEN n_dist <= 0 THEN 1e6 ELSE 1000 * (-n_in / n_target + 0.15 * (n_dist - n_in) / n_dist + 0.02 * off * off + 0.05 * deep * deep) END')} AS fitness, {R('CASE WHEN n_dist <= 0 THEN 0 ELSE n_in / n_target END')} AS coverage, {R('CASE WHEN n_dist <= 0 THEN 1 ELSE (n_dist - n_in) / n_dist END')} AS leak,
 {R('CASE WHEN n_dist <= 0 THEN 1 ELSE off END')} AS centre_distance, {R('CASE WHEN n_dist <= 0 THEN 1 ELSE deep END')} AS depth FROM (SELECT c.*, n_target, {_OFF} AS off, {_DEEP} AS deep FROM ({_CNT}) c JOIN ({sub(SUMMARY)}) s USING (target_id)) t""")
def placement_fitness(spark, d):
    s = P.scored(counts(spark, d), view(spark, d, SUMMARY), 1.0)
    return s.select("pose_id", *[rnd(c).alias(c) for c in ("fitness", "coverage", "leak", "centre_distance", "depth")])


@query("C23_placement_search")
def placement_search(spark, d):
    target = view(spark, d, TARGET)
    access = P.accessible(target.select("target_id", *[F.col(f"g{a}").cast("double").alias(a) for a in "xyz"]), ["target_id"], F.lit(8.0), 1.0)
    limits = target.groupBy("target_id").agg(*[f(f"g{a}").cast("double").alias(f"{a}_{e}") for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))])
    searches = table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("target_id"), F.col("s_suppkey").alias("dist_id"), F.lit(1).alias("axis1"), F.lit(2).alias("axis2"))
    level = (target, view(spark, d, FRAME), view(spark, d, SUMMARY), 1.0)
    best = PS.search(searches, access, limits, view(spark, d, DIST), view(spark, d, SHAPE), level, level)
    return best.select("target_id", "dist_id", rnd("fitness").alias("fitness"), "n_dist", "n_in")


_A1 = _rot(["lx", "ly", "lz"])


@query("C24_insertion_depth", f"""SELECT pose_id, {R(f'greatest(0, 9 - (pz + {_A1[2]}))')} AS depth_mesh_mm, {R(f'26.4 + greatest(0, 9 - (pz + {_A1[2]}))')} AS depth_total_mm FROM (SELECT *, {_ANG}, CASE pose_id % 4 WHEN 1 THEN -10.0 WHEN 3 THEN -10.0 ELSE 0 END AS lx, CASE pose_id % 4 WHEN 2 THEN 11.55 WHEN 3 THEN -10.0 ELSE 0 END AS ly, 0 AS lz FROM ({sub(POSES)}) p) t""")
def insertion_depth(spark, d):
    p = view(spark, d, POSES_SPARK).withColumn("antena", F.concat((F.col("pose_id") % 4 + 1).cast("string"), F.lit("ant")))
    return P.insertion_depth(p, G.placement_layout(spark), F.lit(9.0)).select("pose_id", rnd("depth_mesh_mm").alias("depth_mesh_mm"), rnd("depth_total_mm").alias("depth_total_mm"))
