"""Clouds and grids are worked on in slices of a bounded number of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from thermal_lake.operators import voxel as VX


def cloud_rows(spark, n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    cells = {(d, int(x), int(y), int(z)) for d in range(n) for x, y, z in rng.integers(0, 4 + d % 17, (40, 3))}
    return sorted(cells), spark.createDataFrame(sorted(cells), "d long, ix int, iy int, iz int").coalesce(1)


def plain_regions(cells) -> int:
    left, n = set(cells), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            x, y, z = todo.pop()
            near = {(x + a, y + b, z + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)} & left
            left -= near
            todo += near
    return n


def test_slices_hold_a_bounded_number_of_entries():
    from thermal_lake.operators.packs import slices

    lists = [[1, 2, 3], [], [4], list(range(20)), [5, 6], None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.int64()))], ["k", "v"]).slice(1)
    got = [(b.column(0).to_pylist(), row.tolist(), v.tolist()) for b, row, (v,) in slices(batch, 1, 4)]
    assert got == [([1, 2], [1], [4]), ([3], [0] * 20, list(range(20))), ([4, 5], [0, 0], [5, 6])]


def test_regions_of_many_clouds(spark):
    cells, df = cloud_rows(spark, 60)
    got = {r.d: r.n_regions for r in VX.region_counts(df, ["d"]).collect()}
    assert got == {d: plain_regions([c[1:] for c in cells if c[0] == d]) for d in range(60)}


def test_distances_of_many_grids_of_many_sizes(spark):
    from thermal_lake.functions import numerics

    rng = np.random.default_rng(5)
    flat = rng.integers(0, 30, 200).astype(float)
    start, step, length = np.array([0, 40, 41, 90]), np.array([1, 2, 2, 1]), np.array([17, 20, 20, 110])
    got, want = numerics.line_pass(flat, start, step, length, 1e12), flat.copy()
    for s, t, n in zip(start, step, length):
        line = flat[s : s + n * t : t][:n]
        want[s + np.arange(n) * t] = [min((i - j) ** 2 + v for j, v in enumerate(line)) for i in range(n)]
    assert np.array_equal(got, want)
    grids = {d: rng.random((2 + d % 19, 1 + d % 5, 1 + 7 * d % 21)) < 0.15 * (d % 4) for d in range(24)}
    rows = [(None if d == 23 else d, *map(int, at), bool(v)) for d, g in grids.items() for at, v in np.ndenumerate(g)]
    df = spark.createDataFrame(rows, "d long, ix int, iy int, iz int, occ boolean").coalesce(1)
    out = VX.signed_distance(df, ["d"], 0.5)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # no call of Python per slab
    found = {(23 if r.d is None else r.d, r.ix, r.iy, r.iz): r.sdf for r in out.collect()}
    assert len(found) == len(rows)
    for d, g in grids.items():
        for at, inside in np.ndenumerate(g):
            other = np.argwhere(g != inside)
            want = None if not len(other) else (-0.5 if inside else 0.5) * np.sqrt(((other - at) ** 2).sum(1).min())
            assert found[d, *at] == want


def test_surface_across_tiles_and_without_keys(spark):
    from thermal_lake.operators import mesh as ME

    rng = np.random.default_rng(7)
    rows = [(d, *map(int, at)) for d in (1, None) for at in rng.integers(-19, 20, (1500, 3))]
    rows += [(1, None, 2, 3), (1, 0, 0, 0), (1, 0, 0, 0)]
    out = ME.voxel_surface(spark.createDataFrame(rows, "d int, ix int, iy int, iz int"), ["d"], 0.5)
    assert "LeftAnti" not in out._jdf.queryExecution().toString()  # voxels travel, not their six faces
    have, want = set(rows), []
    for r in rows:
        for face, (step, corners) in enumerate(ME.CUBE_FACES):
            if None in r or (r[0], *(a + b for a, b in zip(r[1:], step))) not in have:
                at = [tuple(None if a is None else (a + b) * 0.5 for a, b in zip(r[1:], c)) for c in corners]
                want += [(*r, face, half, *(at[i] for i in pick)) for half, pick in enumerate(((0, 1, 2), (0, 2, 3)))]
    got = [(r.d, r.ix, r.iy, r.iz, r.face, r.half, *map(tuple, (r.v1, r.v2, r.v3))) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert out.schema["ix"].dataType.simpleString() == out.schema["d"].dataType.simpleString() == "int"
