"""C7 from the raw field: gridding, instants that count, temporal PCA and volumes against plain numpy."""

import numpy as np

from thermal_lake.operators import grid as GR
from thermal_lake.plans import volume4d as V


def field(spark, values, times, key="d"):
    rows = [(key, t, float(times[t]), *map(int, i), *map(float, np.array(i) * [2, 3, 1.5]), None if np.isnan(v) else float(v)) for t in range(len(times)) for i, v in np.ndenumerate(values[t])]
    return spark.createDataFrame(rows, "dataset string, t_idx int, t_min double, ix int, iy int, iz int, x double, y double, z double, t_c double")


def gridded(values, n):
    """The same linear field at the widened grid: per axis weights of the two nearest planes, continued outside."""
    out = values
    for axis, count in enumerate(n):
        size = values.shape[axis]
        u = np.linspace(-0.05 * (size - 1), 1.05 * (size - 1), count)
        c = np.clip(np.floor(u).astype(int), 0, size - 2)
        w = (u - c).reshape([-1 if a == axis else 1 for a in range(3)])
        out = np.take(out, c, axis) * (1 - w) + np.take(out, c + 1, axis) * w
    return out


def test_curves_equal_numpy(spark):
    rng, n, times = np.random.default_rng(3), (5, 4, 3), [0, 1, 2.5, 3, 4.2]
    values = 50 + np.cumsum(rng.normal(8, 4, (5, 4, 3, 3)), axis=0)
    rows, curve = V.from_field(field(spark, values, times), ["dataset"], 7.0, n, 75.0)
    grid = np.array([gridded(v, n) for v in values])
    series = grid.reshape(5, -1).T
    voxel = np.prod([1.1 * (s - 1) * h / (m - 1) for s, h, m in zip(values.shape[1:], (2, 3, 1.5), n)])
    got = {(r.method, r.t_min): r for r in curve.collect()}
    assert {t for m, t in got if m == V.ORIGINAL} == set(times) and {t for m, t in got if m == "pca_temporal"} == {5.0, 6.0, 7.0}
    for k, t in enumerate(times):
        assert np.isclose(got[V.ORIGINAL, t].volume, (series[:, k] >= 75).sum() * voxel)
    c = series - series.mean(1, keepdims=True)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    rank = max(int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.99)) + 1, 3)
    rate = (u[:, :rank] * s[:rank]) @ ((v[:rank, -1] - v[:rank, -2]) / (times[-1] - times[-2]))
    slope = ((series - series[:, -1:]) * (np.array(times) - 4.2)).sum(1) / ((np.array(times) - 4.2) ** 2).sum()
    at = {(r.ix, r.iy, r.iz, r.method, r.t_min): r for r in rows.collect()}
    assert len(at) == 60 * (5 + 9)
    for p in np.ndindex(*n):
        i = np.ravel_multi_index(p, n)
        assert np.isclose(at[*p, "pca_temporal", 6.0].t_c, series[i, -1] + 1.8 * rate[i])
        assert np.isclose(at[*p, "gradiente_local", 6.0].t_c, series[i, -1] + 1.8 * slope[i]) and np.isclose(at[*p, V.ORIGINAL, 2.5].t_base, series[i, 0])
    assert np.isclose(got["pca_temporal", 7.0].volume, (series[:, -1] + 2.8 * rate >= 75).sum() * voxel)


def test_instants_that_count(spark):
    values = 60 + np.random.default_rng(1).normal(size=(5, 3, 3, 3))
    values[1] = np.nan
    values[1, 0, 0, :] = 70  # three values are too few
    values[2, 1, 1, 1] = np.nan  # every cell lacks a corner
    df = field(spark, values, [0, 1, 2, 3, 9])
    times = lambda h: sorted({r.t_min for r in V.from_field(df, ["dataset"], h, (3, 3, 3))[1].where("method = 'fuente'").collect()})
    assert times(0) == [0, 3, 9] and times(5.0) == [0, 3]
    late = field(spark, values[[0, 3, 4]], [6, 7, 8])
    assert sorted({(r.method, r.t_min) for r in V.from_field(late, ["dataset"], 2.0, (3, 3, 3))[1].collect()}) == [("fuente", 6), ("fuente", 7), ("fuente", 8)]
    assert V.from_field(field(spark, values[:1], [0]), ["dataset"], 3.0, (3, 3, 3))[1].count() == 0  # one instant is too few


def test_the_field_is_shuffled_once(spark):
    df = field(spark, 60 + np.random.default_rng(1).normal(size=(3, 4, 4, 4)), [0, 1, 2])
    tiles = GR.halo_tiles(df.withColumn("k", df.t_idx), ["dataset"], "t_c", extra=["k"])
    assert tiles._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    series, _, _ = GR.resampled_series(df, ["dataset"], (3, 3, 3))
    rows = GR.extended(series, ["dataset"], 5.0, "fuente")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "vs#" in plan and "Window" not in plan  # the series are read back, not built again
