"""Smoothing in patches that know a few rings of neighbours, against plain steps over the whole mesh."""

import numpy as np
import pytest

from thermal_lake.operators import mesh as ME


def sheet(n, m, mesh, rng):
    """Triangulated n x m sheet with bumps; vertices are numbered from 1, and one lies apart."""
    vid = lambda i, j: i * m + j + 1
    v = [(mesh, vid(i, j), float(i), float(j), float(rng.normal())) for i in range(n) for j in range(m)] + [(mesh, n * m + 1, 50.0, 50.0, 50.0)]
    f = []
    for i in range(n - 1):
        for j in range(m - 1):
            f += [(mesh, 2 * len(f), vid(i, j), vid(i + 1, j), vid(i, j + 1)), (mesh, 2 * len(f) + 1, vid(i + 1, j), vid(i + 1, j + 1), vid(i, j + 1))]
    return v, f


def plain(v, f, steps):
    p = {vid: np.array(xyz) for _, vid, *xyz in v}
    nb = {vid: set() for vid in p}
    for _, _, a, b, c in f:
        for x, y in ((a, b), (b, c), (c, a)):
            nb[x].add(y)
            nb[y].add(x)
    for k in steps:
        p = {i: x + k * (np.mean([p[j] for j in sorted(nb[i])], axis=0) - x) if nb[i] else x for i, x in p.items()}
    return p


@pytest.mark.parametrize("rings, size", [(3, 10), (1, 10), (4, 4096), (20, 25)])
def test_patches_equal_plain_steps(spark, rings, size):
    rng = np.random.default_rng(0)
    one, two = sheet(9, 11, 1, rng), sheet(4, 3, 2, rng)
    v = spark.createDataFrame(one[0] + two[0], "mesh_id int, vid long, x double, y double, z double")
    f = spark.createDataFrame(one[1] + two[1], "mesh_id int, facet_id long, a long, b long, c long")
    steps = [0.5, -0.53] * 3 + [1.0]
    got = {(r.mesh_id, r.vid): (r.x, r.y, r.z) for r in ME.smoothed(f, v, steps, rings, size).collect()}
    for mesh, (vs, fs) in ((1, one), (2, two)):
        for vid, xyz in plain(vs, fs, steps).items():
            assert np.allclose(got.pop((mesh, vid)), xyz)
    assert not got


def test_no_vertices(spark):
    v = spark.createDataFrame([], "mesh_id int, vid long, x double, y double, z double")
    f = spark.createDataFrame([], "mesh_id int, facet_id long, a long, b long, c long")
    assert ME.laplacian(f, v, 3).count() == 0
