"""Poses of the placement queries: suppliers found by key, masks that ride with a pose as bits."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from registry import QUERIES
from registry import placement_queries as Q
from registry.core import view
from thermal_lake.operators import placement as P


def orders(root, customers, suppliers):
    n = len(customers)
    pq.write_table(pa.table({"o_orderkey": pa.array(range(1, n + 1), pa.int64()), "o_custkey": pa.array(customers, pa.int64()), "o_totalprice": pa.array([1000.0 * i for i in range(n)])}), f"{root}/orders.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(suppliers, pa.int64())}), f"{root}/supplier.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suppliers_of_poses_are_found_by_key(spark, tmp_path):
    orders(tmp_path, [1, 2, 3, 4, 5, 6, None], [1, 2, 2, 0, None])
    found = sorted((r.pose_id, r.dist_id) for r in view(spark, str(tmp_path), Q.POSES_SPARK).collect())
    keys = [1, 2, 2, 0]
    assert found == sorted((i, s) for i, c in enumerate([1, 2, 3, 4, 5, 6], 1) for s in keys if s == c % 5)
    for name in ("F18_rotated_box", "C24_insertion_depth"):
        df = QUERIES[name](spark, str(tmp_path))
        assert df.count() == len(found)
        assert "HashJoin [nth" in plan(df) or "SortMergeJoin [nth" in plan(df)  # the old condition paired every order with every supplier
        assert "Window" not in plan(df)
    orders(tmp_path, [1, 2], [])
    assert view(spark, str(tmp_path), Q.POSES_SPARK).count() == 0


def test_mask_words_hold_every_voxel(spark):
    voxels = [("a", 0, 0, 0), ("a", 4, 3, 4), ("a", 4, 3, 4), ("a", 1, 2, 3), ("a", 5, 0, 0), ("a", -1, 0, 0), ("b", 9, 9, 9), ("c", 0, 0, 0)]
    dist = spark.createDataFrame(voxels, "dist_id string, ix int, iy int, iz int")
    shapes = spark.createDataFrame([("a", 5, 4, 5), ("a", 5, 4, 5), ("b", 10, 10, 10)], "dist_id string, nx int, ny int, nz int")
    held = {}
    for r in P.mask_words(dist, shapes).collect():
        assert all(w != 0 for w in r._words[-1:])
        for i, w in enumerate(r._words):
            for at in (64 * i + b for b in range(64) if w >> b & 1):
                v = r.dist_id, at % r._sx, at // r._sx % r._sy, at // (r._sx * r._sy)
                held[v] = held.get(v, 0) + 1
    assert held == {("a", 0, 0, 0): 1, ("a", 4, 3, 4): 2, ("a", 1, 2, 3): 1, ("b", 9, 9, 9): 1}


def test_counts_join_no_point_with_the_distribution(spark):
    """An upright pose over a 4 x 3 x 2 mask with holes, a voxel that comes twice, and a pose key that does."""
    mask = [(x, y, z) for x in range(4) for y in range(3) for z in range(2) if (x + y + z) % 3]
    voxels = [*mask, mask[0]]
    dist = spark.createDataFrame([(7, *v) for v in voxels], "dist_id long, ix int, iy int, iz int")
    shapes = spark.createDataFrame([(7, 0.0, 1.0, 4, 0.0, 1.0, 3, 0.0, 1.0, 2)], "dist_id long, x0 double, dx double, nx int, y0 double, dy double, ny int, z0 double, dz double, nz int")
    frames = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 9, 9, 9)], "target_id int, gx0 double, gy0 double, gz0 double, gstep double, gxn int, gyn int, gzn int")
    goal = [(x, y, z) for x in range(9) for y in range(9) for z in range(9) if (x * y + z) % 2]
    targets = spark.createDataFrame([(1, *g) for g in goal], "target_id int, gx int, gy int, gz int")
    poses = [(1, 7, 1, 2.0, 3.0, 1.0), (2, 7, 1, 7.0, 7.0, 0.0), (2, 7, 1, 0.0, 0.0, 0.0), (3, 8, 1, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame([(*r, 0.0, 0.0, 1, 2) for r in poses], "pose_id long, dist_id long, target_id int, px double, py double, pz double, a1 double, a2 double, axis1 int, axis2 int")
    counted = P.pose_counts(p, dist, shapes, targets, frames)
    want = {}
    for i, d, _, *at in poses:
        points = [tuple(int(a + c) for a, c in zip(at, v)) for v in voxels if d == 7]
        points = [q for q in points if max(q) < 9]
        n = want.get(i, (0, 0))
        want[i] = n[0] + len(points), n[1] + sum(q in set(goal) for q in points)
    assert sorted((r.pose_id, r.n_dist, r.n_in) for r in counted.collect()) == sorted((r[0], *want[r[0]]) for r in poses)
    joins = [line for line in plan(counted).splitlines() if "Join" in line]
    assert not [line for line in joins if "ix" in line], joins
    assert math.isclose(counted.agg(F.sum("n_dist")).first()[0], sum(want[r[0]][0] for r in poses))
