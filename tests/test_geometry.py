"""Meshes, voxels and skew helpers against brute force."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermal_lake.functions import numerics
from thermal_lake.operators import mesh as ME
from thermal_lake.operators import skew as SK
from thermal_lake.operators import voxel as VX
from thermal_lake.sources import readers as RD


def solid(spark, cells, size=1.0):
    occ = spark.createDataFrame([("m", *c) for c in cells], "mesh_id string, ix int, iy int, iz int")
    s = ME.voxel_surface(occ, ["mesh_id"], size)
    return s.select("mesh_id", F.monotonically_increasing_id().alias("facet_id"), "v1", "v2", "v3").cache()


def test_point_in_concave_solid(spark):
    cells = [(0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 0, 2), (1, 0, 2), (0, 1, 0)]
    mesh = solid(spark, cells)
    rng = np.random.default_rng(1)
    pts = rng.uniform(-0.5, 3.5, size=(400, 3))
    df = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(pts)], "mesh_id string, pid int, x double, y double, z double")
    got = {r.pid: r.inside for r in ME.inside_mesh(df, mesh).collect()}
    for i, p in enumerate(pts):
        assert got[i] == (tuple(np.floor(p).astype(int)) in set(cells))


def test_volume_of_a_cube(spark):
    mesh = solid(spark, [(0, 0, 0)], 10.3)
    v = ME.mesh_volume(mesh, 0.5).first().volume
    assert v == pytest.approx(10.3**3, rel=0.12)
    grid = ME.voxelised(mesh, 1.0).agg(F.count_if("occ").alias("n"), F.max("ix").alias("mx")).first()
    assert grid.mx == 12 and grid.n > 0


def test_surface_is_closed(spark):
    mesh = solid(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0)])
    v, f = ME.index_vertices(mesh)
    adj = f.select(F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e"))
    assert {r["count"] for r in adj.groupBy("e").count().collect()} == {2}


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_match_flood_fill(spark, connectivity):
    rng = np.random.default_rng(5)
    occ = rng.random((14, 12, 9)) < (0.3 if connectivity == 6 else 0.1)
    cells = [tuple(map(int, c)) for c in np.argwhere(occ)]
    df = spark.createDataFrame([("k", *c) for c in cells], "k string, ix int, iy int, iz int")
    got = {(r.ix, r.iy, r.iz): r.root for r in VX.components(df, ["k"], connectivity, block=4).collect()}
    offs = VX.neighbour_offsets(connectivity)
    seen, labels = set(), {}
    for c in cells:
        if c in seen:
            continue
        stack, group = [c], []
        seen.add(c)
        while stack:
            p = stack.pop()
            group.append(p)
            for o in offs:
                q = tuple(a + b for a, b in zip(p, o))
                if q not in seen and all(0 <= v < n for v, n in zip(q, occ.shape)) and occ[q]:
                    seen.add(q)
                    stack.append(q)
        low = min((x << 42) | (y << 21) | z for x, y, z in group)
        labels.update({p: low for p in group})
    assert got == labels
    n = VX.region_counts(df, ["k"], connectivity).first()
    assert n.n_regions == len(set(labels.values()))


def test_signed_distance_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    occ = rng.random((7, 6, 11)) < 0.3
    rows = [("g", *map(int, c), bool(occ[tuple(c)])) for c in np.ndindex(occ.shape)]
    df = spark.createDataFrame(rows, "g string, ix int, iy int, iz int, occ boolean")
    got = {(r.ix, r.iy, r.iz): r.sdf for r in VX.signed_distance(df, ["g"], 0.5).collect()}
    a, b = np.argwhere(occ), np.argwhere(~occ)
    for c in np.ndindex(occ.shape):
        want = 0.5 * (np.sqrt(((a - c) ** 2).sum(1).min()) - np.sqrt(((b - c) ** 2).sum(1).min()))
        assert got[c] == pytest.approx(want)
        assert (got[c] < 0) == bool(occ[c])


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    pts, qs = rng.normal(size=(200, 3)), np.vstack([rng.normal(size=(30, 3)), [[40.0, 0, 0]]])
    P = spark.createDataFrame([("k", i, *map(float, p)) for i, p in enumerate(pts)], "k string, pid int, x double, y double, z double")
    Q = spark.createDataFrame([("k", i, *map(float, p)) for i, p in enumerate(qs)], "k string, qid int, x double, y double, z double")
    got = {}
    for r in ME.nearest(Q, P, ["k"], "qid", "pid", 3).collect():
        got.setdefault(r.qid, {})[r.rn] = r.pid
    for i, q in enumerate(qs):
        order = np.argsort(((pts - q) ** 2).sum(1))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == order.tolist()


def test_nearest_finite_searches_on(spark):
    """Key 1 has its only finite nodes beyond the k nearest; in key 2 the default k reaches the node with most finite instants."""
    nodes = [(1, i, float(i), 0.0, 0.0, 3 if i >= 40 else 0) for i in range(50)] + [(2, i, float(i), 0.0, 0.0, 9 if i == 200 else 1) for i in range(300)]
    N = spark.createDataFrame(nodes, "k long, pid long, x double, y double, z double, n_finite long")
    Q = spark.createDataFrame([(1, 0, 0.2, 0.0, 0.0), (2, 0, 0.2, 0.0, 0.0)], "k long, qid long, x double, y double, z double")
    got = lambda **a: {r.k: r.pid for r in ME.nearest_finite(Q, N, ["k"], "qid", "pid", **a).collect()}
    assert got(k=20) == {1: 40, 2: 0} and got() == {1: 40, 2: 200}
    assert ME.nearest_finite(Q, N.where("n_finite < 0"), ["k"], "qid", "pid").count() == 0


def test_skewed_ordered_operators(spark):
    rng = np.random.default_rng(6)
    rows = [("hot", float(v), int(w)) for v, w in zip(rng.permutation(500), rng.integers(0, 9, 500))] + [("cold", float(i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t double, w int").withColumn("s", F.when(F.col("w") == 0, F.col("t")))
    for rows_per in (1_000_000, 37):
        r = {(x.k, x.t): x.rn for x in SK.ranked(df, ["k"], "t", rows=rows_per).collect()}
        assert all(r[("hot", float(i))] == i + 1 for i in range(500)) and r[("cold", 4.0)] == 5
        c = {(x.k, x.t): x.c for x in SK.running_sum(df, ["k"], "t", "w", "c", rows=rows_per).collect()}
        h = {(x.k, x.t): x.h for x in SK.carried(df, ["k"], "t", [], {"h": "s"}, rows=rows_per).collect()}
        hot = sorted((t, w) for k, t, w in rows if k == "hot")
        total, held = 0, None
        first = next(t for t, w in hot if w == 0)
        for t, w in hot:
            total += w
            held = t if w == 0 else held
            assert c[("hot", t)] == total and h[("hot", t)] == (first if held is None else held)


def test_binary_mesh_and_text_readers(spark, tmp_path):
    tri = list(itertools.product([0.0, 1.5], repeat=3))[:6]
    body = b"".join(struct.pack("<12fH", 0, 0, 0, *sum(tri[i:i + 3], ()), 0) for i in (0, 3))
    (tmp_path / "a.stl").write_bytes(b"x" * 80 + struct.pack("<I", 2) + body)
    m = RD.read_meshes(spark, str(tmp_path)).orderBy("facet_id").collect()
    assert [r.mesh_id for r in m] == ["a", "a"] and m[1].v1.x == tri[3][0] and m[0].v3.y == tri[2][1]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "log.txt").write_text("1 2 3\nTiempo(min)  S 1(C)\tx\n-----\n0.0 37 NaN\n1.0 38 40\nfin\n")
    log = RD.parse_probe_logs(RD.read_texts(spark, str(tmp_path / "t"))).orderBy("t_min", "probe_idx").collect()
    assert [(r.label, r.t_min, r.t_c) for r in log] == [("Sonda_1", 0.0, 37.0), ("Sonda_2", 0.0, None), ("Sonda_1", 1.0, 38.0), ("Sonda_2", 1.0, 40.0)]
    exp = RD.parse_experiments(spark.createDataFrame([("e", "t,a\n60,40\n120,NaN\n180,42\n"), ("f", "5\n3\n4\n")], "ruta string, texto string"))
    got = sorted((r.exp_id, r.t_min, r.t_c) for r in exp.where("t_c IS NOT NULL").collect())
    assert got == [("e", 1.0, 40.0), ("e", 3.0, 42.0), ("f", 0.0, 5.0), ("f", 1 / 60, 3.0), ("f", 2 / 60, 4.0)]


def test_parabola_pass():
    rng = np.random.default_rng(0)
    f = np.where(rng.random((5, 20)) < 0.2, 0.0, 1e12)
    want = np.array([[min((i - j) ** 2 + row[j] for j in range(20)) for i in range(20)] for row in f])
    assert np.array_equal(numerics.parabola_pass(f), want)
