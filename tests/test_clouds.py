"""C14 with the regions of every instant's cloud counted."""

from pyspark.sql import functions as F

from thermal_lake.operators import field as FL


def test_regions_of_each_instant(spark):
    block = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    far = [(x + 40, y, z - 60) for x, y, z in block]
    corner = [(x + 2, y + 2, z + 2) for x, y, z in block]
    clouds = {("a", 0): block, ("a", 1): block + far, ("a", 2): block + corner, ("a", 3): block[:3], ("b", 0): block + far + [(99, 99, 99)], ("b", 1): block}
    rows = [(k, t, float(t), i, 2.0 * x, 3.0 * y, 0.5 * z, 60.0 if (k, t) != ("b", 1) else 500.0) for (k, t), pts in clouds.items() for i, (x, y, z) in enumerate(pts)]
    rows += [("a", 0, 0.0, 90, 70.0, 70.0, 70.0, 20.0), ("a", 0, 0.0, 91, 80.0, 70.0, 70.0, None)]  # outside the window
    df = spark.createDataFrame(rows, "k string, t_idx int, t_min double, point_id int, x double, y double, z double, t_c double")
    status = FL.cloud_status(df, F.lit(50.0), F.lit(100.0), ["k"], spacing=(2.0, 3.0, 0.5))
    got = {(r.k, r.t_idx): (r.n_regions, r.status) for r in status.collect()}
    assert got == {("a", 0): (1, FL.EXPORT), ("a", 1): (2, FL.REGIONS), ("a", 2): (1, FL.EXPORT), ("a", 3): (None, FL.NO_POINTS), ("b", 0): (3, FL.REGIONS), ("b", 1): (None, FL.CUT)}
    counts = {r.k: r.asDict() for r in FL.cloud_outcomes(status, ["k"]).collect()}
    assert counts["a"] == {"k": "a", "corte": 0, "sin_puntos": 1, "varias_regiones": 1, "exportar": 2}
    assert FL.cloud_regions(df.limit(0), F.lit(0.0), F.lit(1.0), (1.0, 1.0, 1.0), ["k"]).count() == 0


def test_block_components_equal_search():
    import numpy as np

    from thermal_lake.functions import numerics
    from thermal_lake.operators.voxel import neighbour_offsets

    rng = np.random.default_rng(0)
    for connectivity, share in ((26, 0.08), (6, 0.25), (8, 0.3), (26, 0.6)):
        offsets = neighbour_offsets(connectivity)
        cells = sorted((b, *map(int, c)) for b in (0, 1, 4) for c in np.argwhere(rng.random((6, 6, 6)) < share))
        at = {c: i for i, c in enumerate(cells)}
        root = numerics.block_components(np.array([c[0] for c in cells]), [np.array([c[k] for c in cells]) for k in (1, 2, 3)], 6, offsets)
        for start in cells:  # the first cell that can be reached
            seen, todo = {start}, [start]
            while todo:
                b, x, y, z = todo.pop()
                for dx, dy, dz in offsets:
                    n = (b, x + dx, y + dy, z + dz)
                    if n in at and n not in seen:
                        seen.add(n)
                        todo.append(n)
            assert root[at[start]] == min(at[c] for c in seen)
    assert len(numerics.block_components(np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3, 6, neighbour_offsets(26))) == 0
