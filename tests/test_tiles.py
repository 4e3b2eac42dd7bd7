"""Packs of rows and halo tiles: sampling across tile borders against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermal_lake.operators import grid as GR
from thermal_lake.operators.packs import packed

N = (20, 17, 33)


def field(spark, values):
    rows = [(1, int(t), float(t), int(i), int(j), int(k), None if np.isnan(v) else float(v)) for (t, i, j, k), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "dataset int, t_idx int, t_min double, ix int, iy int, iz int, t_c double").withColumns(
        {"x": F.col("ix") * 2.0 + 1, "y": F.col("iy") * 0.5, "z": F.col("iz") * 1.0 - 3})


def plain(values, p):
    u = (np.array(p) - [1, 0, -3]) / [2, 0.5, 1]
    c = np.clip(np.floor(u).astype(int), 0, np.array(N) - 2)
    w = u - c
    return sum(values[tuple(c + o)] * np.prod(np.where(o, w, 1 - w)) for o in np.ndindex(2, 2, 2) for o in [np.array(o)])


def test_samples_cross_tile_borders(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(2, *N))
    values[0, 4, 4, 4] = np.nan
    df = field(spark, values)
    tiles = GR.halo_tiles(df, ["dataset", "t_idx"], "t_c")
    sent = tiles.agg(F.sum(F.size("voxels"))).first()[0]
    assert sent == 2 * 21 * 18 * 35  # 16 | 16 + 16 * 16 voxels on borders are sent again, the others once
    assert {(r.tx, r.ty, r.tz) for r in tiles.collect()} == {(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1, 2)}
    shape = GR.grid_shape(df, ["dataset"])
    points = [(1, q, *map(float, p)) for q, p in enumerate(np.concatenate([rng.uniform([-3, -1, -5], [45, 10, 33], (300, 3)), [[33, 8, 13], [1, 0, -3], [39, 8, 29]]]))]
    queries = spark.createDataFrame(points, "dataset int, qid int, x double, y double, z double")
    out = GR.sampled(GR.located(queries, shape, ["dataset"]), tiles, ["dataset"], ["t_idx"], ["qid"]).collect()
    assert len(out) == 2 * len(points)
    for r in out:
        want = plain(values[r.t_idx], points[r.qid][2:])
        assert (r.value is None and np.isnan(want)) or np.isclose(r.value, want)


def test_queries_without_a_tile_keep_a_row(spark):
    df = field(spark, np.ones((1, *N))).where("ix < 3")
    shape = GR.grid_shape(field(spark, np.ones((1, *N))), ["dataset"])
    queries = spark.createDataFrame([(1, 1, 2.0, 1.0, 0.0), (1, 2, 38.0, 1.0, 0.0), (1, 3, 200.0, 1.0, 0.0)], "dataset int, qid int, x double, y double, z double")
    out = {r.qid: r for r in GR.sample_distance(queries, GR.halo_tiles(df, ["dataset"], "t_c"), shape, ["dataset"]).collect()}
    assert {q: (r.distance, r.inside) for q, r in out.items()} == {1: (1.0, False), 2: (1e6, False), 3: (1e6, False)}
    assert set(out[1].asDict()) == {"dataset", "qid", "x", "y", "z", "distance", "inside"}


@pytest.mark.parametrize("hot", [1000, 100])
def test_packs_hold_runs_of_one_key(spark, hot):
    df = spark.range(1000).select(F.when(F.col("id") < 700, F.lit("hot")).when(F.col("id") < 990, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), "id")
    rows = packed(df, ["k"], ["id"], ["id"], 64, hot).collect()
    assert sorted(i for r in rows for i in r.id) == list(range(1000)) and max(len(r.id) for r in rows) <= 64
    assert len({r._block for r in rows}) == len(rows)
    of = lambda i: "hot" if i < 700 else f"k{i % 7}" if i < 990 else None
    assert all(of(i) == r.k for r in rows for i in r.id) and all(r.id == sorted(r.id) for r in rows)
    assert packed(df.limit(0), ["k"], ["id"], ["id"], 64).count() == 0
