"""Correction, caps, extrapolation and curve invariants on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermal_lake.functions import numerics
from thermal_lake.operators import curves as C
from thermal_lake.operators import field as FL
from thermal_lake.operators import grid as GR
from thermal_lake.plans import calibrate as CAL
from thermal_lake.plans import correct as CO
from thermal_lake.plans import volume4d as V4

T1 = [37, 50, 70, 110, 130, 90, 60, 45]
T2 = [45, 75, 95, 125, 150, 88, 66, 55]


def cube(spark, series):
    rows = [("m", "d", i, float(i & 1), float(i >> 1 & 1), float(i >> 2), k, float(k), float(v)) for k, s in enumerate(series) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "modelo string, dataset string, point_id long, x double, y double, z double, t_idx int, t_min double, t_c double")


def one_zone(spark, exp_max, knots=((0.0, 1.0), (1.0, 0.9))):
    zones = spark.createDataFrame([("c", 0, None, None, True, 0.0, 0.0, exp_max)], "corr_id string, zone_id int, z_min double, z_max double, top boolean, t_origin double, offset_c double, exp_max double")
    k = spark.createDataFrame([("c", 0, t, f) for t, f in knots], "corr_id string, zone_id int, t double, f double")
    return zones, k, spark.createDataFrame([("m", "d", "c")], "modelo string, dataset string, corr_id string")


@pytest.mark.parametrize("cfg,limit", [(None, 80.0), (70.0, 70.0)])
def test_cap(spark, cfg, limit):
    zones, knots, pairs = one_zone(spark, 80.0)
    out = CO.correct_field(cube(spark, [T1, T2]), pairs, zones, knots, cap_c=cfg).collect()
    assert max(r.t_corr for r in out) == limit and {r.cap for r in out} == {limit}
    at1 = {r.point_id: r.t_corr for r in out if r.t_idx == 1}
    for i in range(8):
        assert at1[i] == pytest.approx(min(limit, T1[i] + 0.9 * (T2[i] - T1[i])))


def test_intensity_ends(spark):
    zones, knots, pairs = one_zone(spark, 500.0, ((0.0, 0.5), (1.0, 0.5)))
    f = cube(spark, [[37.0] * 8, [60.0] * 8])
    got = lambda k: {r.t_corr for r in CO.correct_field(f, pairs, zones, knots, intensity=k).where("t_idx = 1").collect()}
    assert got(0.0) == {60.0} and got(1.0) == {37 + 0.5 * 23}


def test_inactive_before_first_knot(spark):
    zones, knots, pairs = one_zone(spark, 500.0, ((1.0, 0.5), (2.0, 0.5)))
    out = CO.correct_field(cube(spark, [T1, T2]), pairs, zones, knots).where("t_idx = 0").collect()
    assert [r.t_corr for r in sorted(out, key=lambda r: r.point_id)] == [min(120.0, float(v)) for v in T1]


def test_minutes_kept_and_correction_removed(spark):
    base = np.array([37, 42, 45, 50, 55, 60, 65, 70], float)
    f = cube(spark, [base, base + 5, base + 12]).select(F.lit(1).alias("dataset"), "x", "y", "z", "t_idx", "t_min", "t_c")
    grid = GR.resample(f, ["dataset"], (3, 3, 3)).cache()
    assert [r.t_min for r in grid.select("t_min").distinct().orderBy("t_min").collect()] == [0.0, 1.0, 2.0]
    full, curve = V4.analyse(grid, ["dataset"], 4.0, spark.createDataFrame([(1, 0.5)], "dataset int, voxel double"))
    times = {r.method: set() for r in full.select("method").distinct().collect()}
    for r in full.select("method", "t_min").distinct().collect():
        times[r.method].add(r.t_min)
    assert times.pop(V4.ORIGINAL) == {0.0, 1.0, 2.0}
    assert set(times) == {"gradiente_local", "lowess_cuadratico", "pca_temporal"} and all(v == {3.0, 4.0} for v in times.values())
    zones, knots, _ = one_zone(spark, 90.0, ((0.0, 1.0), (1.0, 0.95), (2.0, 0.9)))
    pairs = spark.createDataFrame([(1, "c")], "dataset int, corr_id string")
    xyz = grid.select("dataset", *GR.VOXEL, "z").distinct()
    again = V4.apply_correction(full.join(xyz, ["dataset", *GR.VOXEL]), ["dataset"], pairs, zones, knots)
    assert "t_corr" in again.columns and "t_corr" not in again.drop("t_corr").columns
    assert again.agg(F.max("t_corr")).first()[0] <= 90.0
    assert all(np.isfinite(r.volume) for r in curve.collect())


def test_pca_matches_full_svd(spark):
    rng = np.random.default_rng(3)
    nt, shape = 9, (3, 2, 4)
    a = rng.normal(size=(24, 3)) @ rng.normal(size=(3, nt)) + 0.3 * rng.normal(size=(24, nt)) + 60
    idx = [(i, j, k) for i in range(3) for j in range(2) for k in range(4)]
    rows = [(1, *p, float(t), float(a[n, t])) for n, p in enumerate(idx) for t in range(nt)]
    f = spark.createDataFrame(rows, "dataset int, ix int, iy int, iz int, t_min double, t_c double")
    got = {(r.ix, r.iy, r.iz, r.t_min): r.t_c for r in GR.pca_trend(f, ["dataset"], 11.0).collect()}
    mean = a.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(a - mean, full_matrices=False)
    r = max(int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.99)) + 1, 3)
    v = vt[:r].T
    for e in (9.0, 10.0, 11.0):
        ext = v[-1] + (v[-1] - v[-2]) * (e - 8)
        want = (u[:, :r] * s[:r]) @ (ext - v[-1]) + a[:, -1]
        for n, p in enumerate(idx):
            assert got[(*p, e)] == pytest.approx(want[n], abs=1e-8)


def test_extrapolation_with_missing_instants(spark):
    """A voxel may lack instants: the dataset's instants count, gaps are zero after centring, and no value at the end gives NULL."""
    rng = np.random.default_rng(5)
    nt, voxels = 8, 10
    a = rng.normal(size=(voxels, nt)).cumsum(axis=1) + 50
    a[1, 3] = a[2, 0] = a[3, nt - 1] = np.nan
    rows = [(1, n, 0, 0, float(t), float(a[n, t])) for n in range(voxels) for t in range(nt) if np.isfinite(a[n, t])]
    f = spark.createDataFrame(rows, "dataset int, ix int, iy int, iz int, t_min double, t_c double")
    c = np.nan_to_num(a - np.nanmean(a, axis=1, keepdims=True))
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    r = min(len(s), max(int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.99)) + 1, 3))
    rate = (u[:, :r] * s[:r]) @ (vt[:r].T[-1] - vt[:r].T[-2])
    got = {(x.method, x.ix, x.t_min): (x.t_c, x.sigma) for x in GR.extrapolations(f, ["dataset"], 9.0).collect()}
    alone = {(x.ix, x.t_min): x.t_c for x in GR.pca_trend(f, ["dataset"], 9.0).collect()}
    assert len(got) == 3 * 2 * voxels
    for n in range(voxels):
        for e in (8.0, 9.0):
            value, sigma = got["pca_temporal", n, e]
            assert value == alone[n, e]
            if n == 3:
                assert value is None
            else:
                assert value == pytest.approx(a[n, -1] + (e - 7) * rate[n], abs=1e-8)
            for method in ("gradiente_local", "lowess_cuadratico"):
                assert (got[method, n, e][0] is None) == (n in (1, 2, 3)), (method, n)
            assert (sigma is None) == (n in (1, 2, 3))
    tail = {(x.ix, x.t_min): (x.a, x.tau) for x in GR.trailing(f, ["dataset"], 3).collect()}
    assert tail[3, 6.0] == (None, -1.0) and tail[0, 5.0] == (a[0, -1], -2.0) and (3, 7.0) not in tail and len(tail) == 3 * voxels - 1


def test_pchip_passes_through_knots_and_is_monotone(spark):
    t, y = [0.0, 1.0, 1.5, 4.0, 6.0], [37.0, 40.0, 40.0, 80.0, 81.0]
    knots = spark.createDataFrame([("a", a, b) for a, b in zip(t, y)], "k string, t double, y double")
    at = np.linspace(-1, 7, 81)
    want = numerics.pchip_eval(t, y, at)
    targets = spark.createDataFrame([("a", float(v)) for v in at], "k string, t double")
    for rows in (1_000_000, 2, 3):
        got = [r.y_interp for r in C.pchip(knots, targets, ["k"], rows=max(rows, 4) if rows < 1000 else rows).orderBy("t").collect()]
        assert np.allclose(got, want, atol=1e-9)
    assert np.allclose(numerics.pchip_eval(t, y, np.array(t)), y)
    inside = want[(at >= 0) & (at <= 6)]
    assert (np.diff(inside) >= -1e-9).all()


def test_ssa_forecast_keeps_limits_and_sign_free():
    t = np.linspace(0, 10, 200)
    m = numerics.ssa_model(t, 0.7 - 0.02 * t + 0.01 * np.sin(t))
    assert m["method"] == "ssa" and len(m["coef"]) == m["window"] - 1
    f = numerics.ssa_forecast(m, np.linspace(10, 30, 50))
    assert f[0] == pytest.approx(m["f_start"]) and (f >= m["low"]).all() and (f <= m["high"]).all()
    assert np.abs(np.diff(numerics.ssa_forecast(m, 10 + m["step"] * np.arange(60)))).max() <= m["max_step"] + 1e-12
    assert numerics.ssa_model(t[:5], t[:5])["method"] == "constant"


def test_calibration_recovers_a_factor(spark):
    rows = []
    for p in range(1, 5):
        for k in range(41):
            t = k * 0.5
            rise = 40 * (1 - np.exp(-t / 5)) + p
            rows.append(("r", p, 0, t + 2, 37 + rise - p))
            rows.append(("r", p, 1, t, 35 + 0.8 * (rise - p)))
    c = spark.createDataFrame([(a, b, s, float(t), float(v)) for a, b, s, t, v in rows], "corr_id string, probe_idx int, side int, t_min double, t_c double")
    parts = CAL.calibrate(c.where("side = 0"), c.where("side = 1"), 60)
    zones = {r.zone_id: r for r in parts["zones"].collect()}
    assert sorted(zones) == [0, 1, 2, 3, 4]
    assert zones[1].z_min is None and zones[1].z_max == pytest.approx(21.9) and zones[4].z_max is None
    assert all(z.offset_c == pytest.approx(-2.0) and z.t_origin == 2.0 for z in zones.values())
    assert all(abs(r.factor - 0.8) < 1e-6 for r in parts["samples"].collect())
    assert all(r.rmse_factor < 1e-6 and r.degree == 6 for r in parts["fits"].collect())


def test_polynomial_fit_matches_numpy(spark):
    rng = np.random.default_rng(0)
    t = np.linspace(0, 20, 80)
    y = np.sin(t / 3) + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y)], "k string, t double, y double")
    got = C.polynomial_fit(df, ["k"], 6).first()
    assert np.allclose(np.polyval(got.poly, t), np.polyval(np.polyfit(t, y, 6), t), atol=1e-7)


def test_sustained_cutoff(spark):
    df = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate([130.0, 90.0, 125.0, 126.0])] + [("b", i, float(i), v) for i, v in enumerate([130.0, 100.0])],
                               "d string, t_idx int, t_min double, t_max_c double")
    got = {r.d: r.cutoff for r in FL.sustained_cutoff(df, F.col("t_max_c") > 120, ["d"]).collect()}
    assert got == {"a": 2.0, "b": None}
