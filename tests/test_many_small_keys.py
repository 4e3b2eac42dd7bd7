"""Many keys with few rows each: no call of Python, no pass over a key's rows and no task per key more than the work needs."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thermal_lake.operators import grid as GR
from thermal_lake.operators import octree as O
from thermal_lake.operators import skew
from thermal_lake.sources import readers as RD
from thermal_lake.sources import writers as WR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_look_ahead_is_one_pass(spark):
    rows = [("a", float(t), {3: 30, 5: 50}.get(t)) for t in range(8)] + [("b", 1.0, None), ("b", 2.0, 7), (None, 1.0, 4), (None, 0.0, None)]
    out = skew.carried(spark.createDataFrame(rows, "k string, t double, v int"), ["k"], "t", [], {"seen": "v"})
    assert "currentrow$(), unboundedfollowing$()" not in plan(out)
    assert {(r.k, r.t): r.seen for r in out.collect()} == {**{("a", float(t)): 50 if t >= 5 else 30 for t in range(8)}, ("b", 1.0): 7, ("b", 2.0): 7, (None, 0.0): 4, (None, 1.0): 4}


def test_small_packs_are_looked_up_together():
    side, packs, rng = 17, 300, np.random.default_rng(2)
    values = rng.normal(size=(packs, 2, 3, 2))
    at = [(x * side + y) * side + z for x in range(2) for y in range(3) for z in range(2)]
    voxels = pa.array([None if p == 7 else [{"at": a, "v": float(v)} for a, v in zip(at, values[p].ravel())] for p in range(packs)], pa.list_(pa.struct([("at", pa.int32()), ("v", pa.float64())])))
    n = rng.integers(1, 4, packs)
    cells = [[rng.integers(0, m, k) for k in n] for m in (1, 2, 1)]
    offsets = [[rng.normal(size=k) for k in n] for _ in range(3)]
    batch = pa.RecordBatch.from_arrays([voxels, *[pa.array(c, pa.list_(pa.int32())) for c in cells], *[pa.array(c, pa.list_(pa.float64())) for c in offsets]], list("vabcxyz"))
    (part, row, out), = GR._looked_up(batch, 0, side)
    assert part.num_rows == packs and row.tolist() == np.repeat(np.arange(packs), n).tolist() and np.isnan(out[row == 7]).all()
    for p, k in ((0, 0), (299, 0), (150, n[150] - 1)):
        c, w = [q[p][k] for q in cells], [q[p][k] for q in offsets]
        block = values[p][tuple(slice(i, i + 2) for i in c)]
        for f in w:
            block = block[0] * (1 - f) + block[1] * f
        assert np.isclose(out[np.flatnonzero(row == p)[k], 0], block)
    far = pa.array([[{"at": side**3 - 1, "v": 1.0}]] * packs, voxels.type)
    runs = list(GR._looked_up(batch.set_column(0, "v", far), 0, side))
    assert len(runs) > 1 and sum(len(r) for _, r, _ in runs) == n.sum()  # full tiles: a bounded number at once


def test_keys_of_one_tile_are_searched_at_once(spark):
    rng = np.random.default_rng(5)
    sizes = {"one": 40, "few": 3, "same": 30, "big": 1500}
    points = {k: np.zeros((n, 3)) if k == "same" else rng.integers(0, 9, (n, 3)).astype(float) for k, n in sizes.items()}
    queries = {k: rng.uniform(-1, 10, (25, 3)) for k in [*sizes, "none"]}
    rows = lambda d: [(k, i, *map(float, p)) for k, ps in d.items() for i, p in enumerate(ps)]
    q = spark.createDataFrame(rows(queries) + [("one", 3, 1.0, 1.0, 1.0)], "k string, qid long, x double, y double, z double")
    p = spark.createDataFrame([(*r, r[1] / 2) for r in rows(points)], "k string, pid long, x double, y double, z double, v double")
    small = O.nearest(q, p.where("k != 'big'"), ["k"], "qid", "pid", 4, "v")
    assert "FlatMapGroupsInArrow" not in plan(small)
    found = {}
    for r in O.nearest(q, p, ["k"], "qid", "pid", 4, "v").collect():
        assert r.v == r.pid / 2
        found.setdefault((r.k, r.qid), []).append((r.rn, r.pid, r.distance))
    assert len(found) == 4 * 25 and sorted(r[0] for r in found["one", 3]) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert {(k, i): sorted(v) for (k, i), v in found.items() if k != "big"} == {
        (k, i): sorted(v) for (k, i), v in _grouped(small.collect()).items()}
    for (k, i), got in found.items():
        if (k, i) != ("one", 3):
            d = np.sqrt(((points[k] - queries[k][i]) ** 2).sum(1))
            want = np.lexsort((np.arange(len(d)), d))[:4]
            assert [g[1] for g in sorted(got)] == want.tolist() and np.allclose([g[2] for g in sorted(got)], d[want])


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault((r.k, r.qid), []).append((r.rn, r.pid, r.distance))
    return out


def test_products_and_modes_of_many_datasets(spark):
    rng = np.random.default_rng(8)
    series = {(f"d{i}", i % 3): rng.normal(size=(4, 2 + i % 4)) for i in range(30)}
    rows = [(a, b, [float(x) for x in s]) for (a, b), m in series.items() for s in m]
    df = spark.createDataFrame(rows + [(None, 1, [1.0, 2.0])], "a string, b int, cs array<double>")
    gram = GR.time_gram(df, ["a", "b"])
    assert "MapInPandas" not in plan(gram)
    got = {(r.a, r.b, r.i, r.j): r.g for r in gram.collect()}
    assert len(got) == sum(m.shape[1] ** 2 for m in series.values())
    assert all(np.isclose(got[*k, i, j], (m.T @ m)[i, j]) for k, m in series.items() for i in range(m.shape[1]) for j in range(m.shape[1]))
    times = spark.createDataFrame([(*k, None if k[0] == "d4" else 0.5) for k in series], "a string, b int, step double")
    modes = GR.pca_direction(gram, times, ["a", "b"])
    assert "FlatMapGroups" not in plan(modes)
    for r in modes.collect():
        _, s, v = np.linalg.svd(series[r.a, r.b], full_matrices=False)
        assert 1 <= r["rank"] <= len(s) and np.isclose(r.energy, (s[: r["rank"]] ** 2).sum() / (s**2).sum())
        v = v[: r["rank"]]
        assert np.allclose(r.direction, np.zeros(v.shape[1]) if r.a == "d4" else v.T @ ((v[:, -1] - v[:, -2]) / 0.5))


def test_probe_folders_are_dealt_out(spark, tmp_path):
    rows = [(f"m{i % 2}", f"d{i}", p, float(t), i + t / 8) for i in range(40) for p in ("S0", "S1") for t in (10, 2) if (i, p, t) != (3, "S1", 2)]
    df = spark.createDataFrame(rows, "modelo string, dataset string, probe string, t_min double, t_c double")
    WR.write_probe_tables(df, ["S0", "S1"], str(tmp_path / "t"))
    files = list(Path(tmp_path / "t").glob("modelo=*/dataset=*/*.csv"))
    assert len(files) == 40 and len({re.match(r"part-(\d+)", f.name)[1] for f in files}) > 4
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    back = RD.read_probe_tables(spark, str(tmp_path / "t"), ["S0", "S1"])
    assert spark.conf.get(setting) == before
    got = {(r.modelo, r.dataset, r["Tiempo(min)"]): (r["S0(C)"], r["S1(C)"]) for r in back.collect()}
    assert len(got) == 80 and got["m1", "d3", "2.0000"] == ("3.2500", "NaN") and got["m0", "d38", "10.0000"] == ("39.2500", "39.2500")
    assert back.where(F.col("dataset") == "d3").count() == 2
