"""C20: outcomes of mesh files and what a second run does; clipped distances from neighbourhoods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermal_lake.functions import numerics
from thermal_lake.operators import voxel as VX
from thermal_lake.plans import voxelise as V


def boxes(spark, sizes):
    """Sheared boxes, two facets a side."""
    quads = [((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)),
             ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))]
    place = lambda p, s: (p[0] * s[0] + 0.21 * p[2] * s[2], float(p[1] * s[1]), float(p[2] * s[2]))
    rows = [(m, 2 * i + j, *[place(q[k], s) for k in t]) for m, s in sizes.items() for i, q in enumerate(quads) for j, t in enumerate(((0, 1, 2), (0, 2, 3)))]
    point = "struct<x:double,y:double,z:double>"
    return spark.createDataFrame(rows, f"mesh_id int, facet_id long, v1 {point}, v2 {point}, v3 {point}")


FILES = [(1, "stl/Monopolo/2ant/Caso_1/Potencia_20W/Tiempo_5min/a.stl", 10, 1.5), (2, "stl/otro/2ant/Caso_1/Potencia_20W/Tiempo_5min/b.stl", 10, 1.5),
         (3, "stl/Monopolo/2ant/Caso_2/Potencia_20W/Tiempo_5min/c.stl", 10, 1.5), (4, "stl/Monopolo/2ant/Caso_1/Potencia_10W/Tiempo_1min/d.stl", 10, 1.5),
         (5, "stl/Monopolo/2ant/Caso_1/Potencia_20W/Tiempo_6min/e.stl", 10, 1.5), (6, "Repetidos/Monopolo/2ant/Caso_1/Potencia_20W/Tiempo_6min/f.stl", 10, 1.5)]


def test_a_second_run_does_nothing(spark):
    files = spark.createDataFrame(FILES, "mesh_id int, ruta string, bytes long, mtime_days double")
    facets = boxes(spark, {m: (6.3, 4.1, 5.2) for m in range(1, 7)})
    none = spark.createDataFrame([], "ruta string, signature string")
    run = lambda f, done: V.voxelise(f, facets, done, 1.0, "sdf", {"caso": 1.0})
    voxels, state, new = run(files, none)
    assert {r.mesh_id: r.outcome for r in state.collect()} == {1: V.PROCESSED, 2: V.NO_METADATA, 3: V.FILTERED, 4: V.TOO_EARLY, 5: V.PROCESSED}
    assert {r.mesh_id for r in voxels.select("mesh_id").distinct().collect()} == {1, 5}
    again, state, more = run(files, new)
    assert again.count() == 0 and more.count() == 0
    assert {r.outcome: r.n for r in V.counters(state).collect()} == {V.NO_METADATA: 1, V.FILTERED: 1, V.TOO_EARLY: 1, V.CURRENT: 2, V.PROCESSED: 0}
    changed = files.withColumn("mtime_days", F.when(F.col("mesh_id") == 5, 1.75).otherwise(F.col("mtime_days")))
    _, state, more = run(changed, new)
    assert [r.ruta[-5:] for r in more.collect()] == ["e.stl"]
    assert V.counters(V.states(files.limit(0), none, 1.0)).where("n > 0").count() == 0


def test_three_kinds_agree(spark):
    facets = boxes(spark, {1: (9.3, 4.1, 5.2), 2: (3.3, 19.1, 4.7), 3: (0.2, 0.2, 0.2)})
    at = lambda df: {(r.mesh_id, r.ix, r.iy, r.iz): r for r in df.collect()}
    mask, full, band = at(V.represented(facets, 1.0, "mascara")), at(V.represented(facets, 1.0)), at(V.represented(facets, 1.0, "tsdf"))
    assert set(mask) == set(full) == set(band)
    assert all(mask[k].occ == full[k].occ == band[k].occ and full[k].tsdf == band[k].tsdf for k in mask)
    assert any(r.occ for r in mask.values()) and all(r.sdf is None and r.tsdf == 2 for k, r in full.items() if k[0] == 3)
    with pytest.raises(ValueError):
        V.represented(facets, 1.0, "other")


def test_clipped_distance_across_tiles(spark):
    rng = np.random.default_rng(1)
    occ = rng.random((9, 14, 20)) < np.linspace(0, 1, 20)
    rows = [("g", *map(int, i), bool(v)) for i, v in np.ndenumerate(occ) for i in [i]]
    rows += [("full", i, j, 0, True) for i in range(5) for j in range(5)] + [("none", i, 0, 0, False) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, ix int, iy int, iz int, occ boolean")
    got = {(r.g, r.ix, r.iy, r.iz): (r.occ, r.tsdf) for r in VX.truncated_distance(df, ["g"], 0.5, edge=4).collect()}
    assert len(got) == len(rows) and all(got[g, i, 0, 0] == (g == "full", 1.0 if g == "none" else -1.0) for g, i in [("none", 1), ("full", 2)])
    grid = np.argwhere(np.ones_like(occ))
    for p in grid[rng.choice(len(grid), 300, replace=False)]:
        d = np.sqrt(((grid[occ.ravel() != occ[tuple(p)]] - p) ** 2).sum(1)).min()
        assert np.isclose(got["g", *map(int, p)][1], 0.5 * min(d, 2) * (-1 if occ[tuple(p)] else 1))


def test_envelope_of_long_rows():
    rng = np.random.default_rng(0)
    for f in (np.where(rng.random((20, 300)) < 0.02, 0.0, 1e12), rng.integers(0, 2000, (15, 120)).astype(float), np.full((2, 9), 1e12), np.zeros((3, 1)), np.zeros((0, 5))):
        i = np.arange(f.shape[1])
        assert np.array_equal(numerics.parabola_pass(f), ((i[:, None] - i) ** 2 + f[:, None, :]).min(2) if len(f) else f)
