"""The octree, nearest neighbours through it, and gridding of scattered clouds, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermal_lake.operators import grid as GR
from thermal_lake.operators import mesh as ME
from thermal_lake.operators import octree as O


def cloud(n, kind, seed=0, keys=2):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)) * [10, 5, 1]
    if kind == "dense":  # nine tenths of the points in a hundredth of the volume
        p = rng.uniform(-1, 1, (n, 3))
        m = rng.random(n) < 0.9
        p[m] = 0.5 + p[m] * 0.1
    if kind == "same":
        p[rng.random(n) < 0.5] = [1, 1, 1]
    return pd.DataFrame({"m": rng.choice([f"k{i}" for i in range(keys)], n), "pid": np.arange(n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "t": rng.random(n)})


def brute(q, points, k):
    p = points[(points.m == q.m) & np.isfinite(points[["x", "y", "z"]]).all(axis=1)]
    d = np.sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2).to_numpy()
    order = np.lexsort((p.pid, d))[:k]
    return [(int(p.pid.iloc[i]), d[i], p.t.iloc[i]) for i in order]


@pytest.mark.parametrize("kind, n, k, tile", [("even", 40, 8, 512), ("dense", 4000, 5, 16), ("same", 4000, 3, 16), ("even", 700, 250, 512)])
def test_nearest_equals_brute_force(spark, monkeypatch, kind, n, k, tile):
    monkeypatch.setattr(O, "TILE", tile)
    points, queries = cloud(n, kind), cloud(150, "even", 1, keys=3).rename(columns={"pid": "qid"}).drop(columns="t")
    queries[["x", "y", "z"]] *= 1.5  # some lie outside
    points.loc[3, "x"], queries.loc[7, "z"] = np.nan, np.nan
    got = {}
    for r in O.nearest(spark.createDataFrame(queries), spark.createDataFrame(points), ["m"], "qid", "pid", k, "t").orderBy("qid", "rn").collect():
        got.setdefault(r.qid, []).append((r.pid, r.distance, r.t))
    want = {q.qid: brute(q, points, k) for q in queries.itertuples() if q.qid != 7}
    assert got == {q: v for q, v in want.items() if v}


def test_search_ends_on_missing_places(spark):
    points = spark.createDataFrame([("a", 1, None, 0.0, 0.0), ("a", 2, 1.0, 0.0, 0.0), ("a", 3, float("nan"), 0.0, 0.0), ("b", 4, None, None, None)], "k string, pid int, x double, y double, z double")
    queries = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, None, 0.0, 0.0), ("b", 3, 0.0, 0.0, 0.0), ("c", 4, 0.0, 0.0, 0.0)], "k string, qid int, x double, y double, z double")
    out = ME.nearest(queries, points, ["k"], "qid", "pid", 2)
    assert [tuple(r) for r in out.collect()] == [("a", 1, 2, 1.0, 1)] and dict(out.dtypes)["pid"] == "int"
    assert ME.nearest(queries, points.limit(0), ["k"], "qid", "pid", 2).count() == 0 and ME.nearest(queries.limit(0), points, ["k"], "qid", "pid").count() == 0


def test_null_keys_and_several_keys(spark):
    points = spark.createDataFrame([(1, "u", 1, 0.0), (1, None, 2, 0.1), (None, "u", 3, 0.2), (1, "u", 4, 5.0)], "a int, b string, pid int, x double").selectExpr("*", "0D AS y", "0D AS z")
    out = ME.nearest(points.withColumnRenamed("pid", "qid"), points, ["a", "b"], "qid", "pid", 5)
    assert sorted((r.qid, r.pid) for r in out.collect()) == [(1, 1), (1, 4), (4, 1), (4, 4)]  # a null key equals no key


@pytest.mark.parametrize("kind", ["dense", "same"])
def test_tiles_stay_small(spark, kind):
    points = O.placed(spark.createDataFrame(cloud(6000, kind, keys=1)))
    cells = O.tiled(O.coded(points.join(O.extents(points, ["m"], 20), "m")), ["m"], 5)
    sizes = [r["count"] for r in cells.groupBy("m", "_tile", "_part").count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == (6000 if kind == "dense" else cells.count())
    if kind == "same":  # of the points at one place the five first are kept
        assert cells.where("x = 1").count() == 5


def test_points_nearly_at_one_place_are_dealt_out(spark):
    points = spark.range(500).select(F.lit("a").alias("m"), F.col("id").alias("pid"), (1 + F.col("id") * 1e-12).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    points = points.unionByName(points.limit(1).withColumns({"x": F.lit(9.0), "pid": F.lit(-1).cast("long")}))
    cells = O.tiled(O.coded(points.join(O.extents(points, ["m"], 50), "m")), ["m"], 5)
    sizes = [r["count"] for r in cells.groupBy("_tile", "_part").count().collect()]
    assert sum(sizes) == 501 and max(sizes) < 100


def test_scattered_cloud_is_gridded(spark):
    rng = np.random.default_rng(2)
    rows = [("d", t, float(t), i, *map(float, rng.uniform(0, 10, 3)), float(rng.uniform(30, 90))) for t, n in ((0, 30), (1, 3), (2, 4), (3, 12)) for i in range(n)]
    rows += [("d", 0, 0.0, 100, -0.0, 5.0, 5.0, None), ("d", 0, 0.0, 101, None, 5.0, 5.0, 60.0)]
    df = spark.createDataFrame(rows, "dataset string, t_idx int, t_min double, point_id long, x double, y double, z double, t_c double")
    out = GR.resample_scattered(df, ["dataset"], "point_id", (3, 4, 2), k=5).collect()
    good = [r for r in rows if r[4] is not None and r[7] is not None]
    lo, hi = np.min([r[4:7] for r in good], 0), np.max([r[4:7] for r in good], 0)
    lo, hi = lo - 0.05 * (hi - lo), hi + 0.05 * (hi - lo)
    assert len(out) == 3 * 24  # three values are too few at instant 1
    for r in out:
        at = lo + np.array([r.ix / 2, r.iy / 3, r.iz]) * (hi - lo)
        here = [g for g in good if g[1] == r.t_idx]
        d = np.sqrt(((np.array([g[4:7] for g in here]) - at) ** 2).sum(1))
        near = np.argsort(d)[:5]
        w = 1 / d[near] ** 2
        assert np.allclose([r.x, r.y, r.z], at) and np.isclose(r.t_c, (w * np.array([here[i][7] for i in near])).sum() / w.sum())


def test_grid_point_on_points_of_the_cloud(spark):
    rows = [("d", 0, 0.0, i, float(x), float(y), 0.0, 10.0 * x + y) for i, (x, y) in enumerate([(0, 0), (2, 0), (0, 2), (2, 2), (2, 2)])]
    df = spark.createDataFrame(rows, "dataset string, t_idx int, t_min double, point_id long, x double, y double, z double, t_c double")
    out = {(r.ix, r.iy): r.t_c for r in GR.resample_scattered(df, ["dataset"], "point_id", (3, 3, 2), margin=0.0, k=2).where("iz = 0").collect()}
    assert out[0, 0] == 0 and out[2, 2] == 22 and out[1, 0] == 10
