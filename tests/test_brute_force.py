"""Queries that SQL cannot say, against their plain definition: SSA, k-means, the placement search and its bounds."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermal_lake.functions.colour import FEATURES
from thermal_lake.functions.numerics import pchip_eval
from thermal_lake.operators import field as FL
from thermal_lake.operators import pixels as PX
from thermal_lake.operators import placement as P
from thermal_lake.plans import placement_search as S


def trajectory_forecast(t, f, ahead):
    """The recurrence from the whole trajectory matrix, by eigenvectors of its product with itself."""
    tail = t[t >= t[-1] - 0.5 * (t[-1] - t[0])]
    n = min(301, max(40, len(tail)))
    even = np.linspace(tail[0], t[-1], n)
    x = pchip_eval(t, f, even)
    window = min(min(80, max(12, n // 4)), n - 2)
    c = x - x.mean()
    matrix = np.array([[c[i + j] for j in range(n - window + 1)] for i in range(window)])
    values, modes = np.linalg.eigh(matrix @ matrix.T)
    values, modes = values[::-1], modes[:, ::-1]
    share = np.cumsum(values) / values.sum()
    rank = max(1, min(int(np.flatnonzero(share >= 0.99)[0]) + 1, 8, window - 2))
    u, last = modes[:-1, :rank], modes[-1, :rank]
    coef = sum(u[:, k] * last[k] for k in range(rank)) / (1 - (last**2).sum())
    margin = max(0.01, 0.2 * (x.max() - x.min()))
    low, high = max(0, x.min() - margin), min(1, x.max() + margin)
    step = max(1e-6, 5 * np.median(np.abs(np.diff(x[-(min(40, n - 1) + 1):]))))
    level, lags, out = [f[-1]], list(c[-(window - 1):]), []
    width = np.median(np.diff(even))
    for _ in range(int(np.ceil((max(ahead) - t[-1]) / width)) or 1):
        want = sum(a * b for a, b in zip(coef, lags[-len(coef):])) + x.mean()
        new = level[-1] + min(max(want - level[-1], -step), step)
        level.append(min(max(new, low), high))
        lags.append(level[-1] - x.mean())
    return [np.interp(max(0, a - t[-1]), np.arange(len(level)) * width, level) for a in ahead]


def test_ssa_equals_trajectory_matrix(spark):
    rng = np.random.default_rng(4)
    curves = {(1, 1): 0.9 - 0.02 * np.arange(60) * 0.2, (1, 2): 0.7 + 0.1 * np.sin(np.arange(60) * 0.2), (2, 1): 0.6 + 0.05 * np.cos(np.arange(60) * 0.5) - 0.004 * np.arange(60) + 0.002 * rng.normal(size=60)}
    t = np.arange(60) * 0.2
    knots = spark.createDataFrame([(c, z, float(a), float(b)) for (c, z), f in curves.items() for a, b in zip(t, f)], "corr_id long, zone_id int, t double, f double")
    ahead = [11.8, 12.0, 12.5, 14.0, 19.0]
    at = spark.createDataFrame([(c, z, a + 1, a) for c, z in curves for a in ahead], "corr_id long, zone_id int, t_min double, t_rel double")
    models = FL.ssa_models(knots)
    assert {r.method for r in models.collect()} == {"ssa"}
    got = {(r.corr_id, r.zone_id, round(r.t_min - 1, 6)): r.f_out for r in FL.forecast(models, at).collect()}
    for key, f in curves.items():
        assert np.allclose([got[*key, a] for a in ahead], trajectory_forecast(t, f, ahead), atol=1e-9)


def test_clusters_equal_plain_rounds(spark):
    rng, k, starts = np.random.default_rng(2), 3, 4
    px = pd.DataFrame([{"image_id": i, "row": r, "col": c, **dict(zip(FEATURES, rng.normal(3 * rng.integers(0, k), 1, len(FEATURES))))} for i in range(2) for r in range(1, 9) for c in range(1, 9)])
    df = spark.createDataFrame(px)
    got = {(r.image_id, r.row, r.col): r.cluster for r in PX.clusters(df, k, starts).collect()}
    hashes = df.select("image_id", "row", "col", *[F.xxhash64(F.lit(1), F.lit(s), "row", "col").alias(f"h{s}") for s in range(starts)]).toPandas()
    for i in range(2):
        mine = px[px.image_id == i].reset_index(drop=True)
        x, h = mine[list(FEATURES)].to_numpy(), hashes[hashes.image_id == i].reset_index(drop=True)
        runs = []
        for s in range(starts):
            centres = x[h.sort_values([f"h{s}", "row", "col"]).index[:k]]
            for _ in range(400):
                at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
                new = np.array([x[at == c].mean(0) if (at == c).any() else centres[c] for c in range(k)])
                moved, centres = np.abs(new - centres).max(), new
                if moved == 0:
                    break
            d = ((x[:, None] - centres) ** 2).sum(2)
            runs.append((round(d.min(1).sum(), 9), s, d.argmin(1) + 1))
        best = min(runs, key=lambda r: r[:2])[2]
        assert [got[i, r, c] for r, c in zip(mine.row, mine.col)] == list(best)


def rotation(pose):
    angle = [pose.a2 if pose.axis2 == k else pose.a1 if pose.axis1 == k else 0.0 for k in (1, 2, 3)]
    (cx, cy, cz), (sx, sy, sz) = map(math.cos, angle), map(math.sin, angle)
    return np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])


N_GRID = (9, 8, 7)


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(8)
    target = [(t, *map(int, g)) for t in (1, 2) for g in np.argwhere(rng.random(N_GRID) < 0.35)]
    dist = [(d, *map(int, v)) for d in (10, 11) for v in np.argwhere(rng.random((4, 3, 4)) < 0.7)]
    shape = [(d, -1.5, 1.0, 4, -1.0, 1.0, 3, -1.5, 1.0, 4) for d in (10, 11)]
    frame = [(t, 0.0, 0.0, 0.0, 1.0, *N_GRID) for t in (1, 2)]
    tables = {
        "targets": spark.createDataFrame(target, "target_id int, gx int, gy int, gz int"), "dist": spark.createDataFrame(dist, "dist_id int, ix int, iy int, iz int"),
        "shapes": spark.createDataFrame(shape, "dist_id int, x0 double, dx double, nx int, y0 double, dy double, ny int, z0 double, dz double, nz int"),
        "frames": spark.createDataFrame(frame, "target_id int, gx0 double, gy0 double, gz0 double, gstep double, gxn int, gyn int, gzn int")}
    tables["summary"] = tables["targets"].groupBy("target_id").agg(F.count(F.lit(1)).alias("n_target"), *[F.avg(f"g{a}").alias(f"c{a}") for a in "xyz"], F.lit(9.0).alias("extent"), F.lit(6.0).alias("z_access"))
    return tables, {(t, *g) for t, *g in target}, {(d, *v) for d, *v in dist}


def counts(pose, target, dist):
    """Every grid position against the turned distribution."""
    m, n_dist, n_in = rotation(pose), 0, 0
    for g in np.ndindex(*N_GRID):
        u = m.T @ (np.array(g) - [pose.px, pose.py, pose.pz]) + [1.5, 1.0, 1.5]
        if (u >= 0).all() and (u <= [3, 2, 3]).all() and (pose.dist_id, *np.floor(u + 0.5).astype(int)) in dist:
            n_dist += 1
            n_in += (pose.target_id, *g) in target
    return n_dist, n_in


def test_search_equals_full_sweep(spark, scene):
    tables, target, dist = scene
    searches = spark.createDataFrame([(1, 10, 1, 2), (1, 11, 2, 3), (2, 10, 3, 1)], "target_id int, dist_id int, axis1 int, axis2 int")
    access = tables["targets"].select("target_id", *[F.col(f"g{a}").cast("double").alias(a) for a in "xyz"])
    limits = access.groupBy("target_id").agg(*[f(a).alias(f"{a}_{e}") for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))])
    level = (tables["targets"], tables["frames"], tables["summary"], 1.0)
    found = {(r.target_id, r.dist_id): r for r in S.search(searches, access, limits, tables["dist"], tables["shapes"], level, level, candidates=(25, 12)).collect()}
    summary = {r.target_id: r for r in tables["summary"].collect()}

    def winners(poses):
        best = {}
        for p in poses:
            n_dist, n_in = counts(p, target, dist)
            s = summary[p.target_id]
            off = math.dist((p.px, p.py, p.pz), (s.cx, s.cy, s.cz)) / s.extent
            deep = max(0, s.z_access - p.pz) / s.extent
            fit = 1e6 if not n_dist else 1000 * (-n_in / s.n_target + 0.15 * (n_dist - n_in) / n_dist + 0.02 * off**2 + 0.05 * deep**2)
            key = (p.target_id, p.dist_id)
            best[key] = min(best.get(key, (math.inf, 0)), (fit, p.pose_id))
        return best

    first = S.first_candidates(searches, access, 1, 25)
    one = winners(first.collect())
    kept = first.join(spark.createDataFrame([(int(i),) for _, i in one.values()], "pose_id long"), "pose_id")
    two = winners(S.second_candidates(kept, limits, 2, 12).collect())
    assert {k: r.pose_id for k, r in found.items()} == {k: i for k, (_, i) in two.items()}
    assert all(np.isclose(found[k].fitness, fit) for k, (fit, _) in two.items())


def test_bounds_hold_and_save_points(spark, scene):
    tables, _, dist = scene
    rng = np.random.default_rng(1)
    target = {(t, x, y, z) for t in (1, 2) for x, y, z in np.ndindex(4, 4, 4)}  # in one corner of the grid
    goal = spark.createDataFrame(sorted(target), "target_id int, gx int, gy int, gz int")
    tables = {**tables, "targets": goal, "summary": goal.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_target"), *[F.avg(f"g{a}").alias(f"c{a}") for a in "xyz"], F.lit(9.0).alias("extent"), F.lit(6.0).alias("z_access"))}
    rows = [(i, int(rng.choice([10, 11])), int(rng.choice([1, 2])), *map(float, rng.uniform([-2, -2, -2], [11, 10, 9])), float(rng.uniform(-0.3, 0.3)), float(rng.uniform(0, 3)), 1 + i % 3, 1 + (i + 1) % 3) for i in range(120)]
    poses = spark.createDataFrame(rows, "pose_id long, dist_id int, target_id int, px double, py double, pz double, a1 double, a2 double, axis1 int, axis2 int")
    level = (tables["targets"], tables["frames"], tables["summary"], 1.0)
    sums = P.summed_volume(tables["targets"], tables["frames"])
    below = {(r.target_id, r.gx, r.gy, r.gz): r.below for r in sums.collect()}
    assert len(below) == 2 * math.prod(N_GRID) and all(below[t, *g] == sum(k[0] == t and all(a <= b for a, b in zip(k[1:], g)) for k in target) for t, *g in [(1, 3, 4, 2), (2, 8, 7, 6), (1, 0, 0, 0)])
    score = lambda p: P.scored(P.pose_counts(p, tables["dist"], tables["shapes"], tables["targets"], tables["frames"]), tables["summary"], 1.0)
    real = {r.pose_id: r for r in score(poses).collect()}
    bounds = {r.pose_id: r for r in P.pose_bounds(poses, tables["shapes"], sums, tables["frames"], tables["summary"], 1.0).collect()}
    assert all(bounds[i].n_most >= r.n_in and bounds[i].fitness_least <= r.fitness for i, r in real.items()) and len(bounds) == 120
    for p in poses.limit(15).collect():
        assert (real[p.pose_id].n_dist, real[p.pose_id].n_in) == counts(p, target, dist)
    first, rest = S.promising(poses, tables["shapes"], sums, level, score)
    expanded = sum(bounds[r.pose_id].n_points for r in first.unionByName(rest, allowMissingColumns=True).collect())
    assert expanded < 0.5 * sum(b.n_points for b in bounds.values())
    best = {(r.target_id, r.dist_id): min((x.fitness, x.pose_id) for x in real.values() if (x.target_id, x.dist_id) == (r.target_id, r.dist_id)) for r in first.collect()}
    kept = {r.pose_id for r in rest.collect()} | {r.pose_id for r in first.collect()}
    assert len(best) == 4 and {i for _, i in best.values()} <= kept
