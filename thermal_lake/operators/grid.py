"""Regular grids: generation, sampling, resampling, extrapolation in time, slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .packs import SLICE, packed, slices, types_of
from .skew import broadcast_if_small, carried, spread

VOXEL = ("ix", "iy", "iz")
CORNERS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
# Analysis grid, trailing window, kept energy, viewer cap per axis.
GRID_N, TRAIL, ENERGY, AXIS_CAP = 45, 12, 0.99, 95
PLACE = ("tx", "ty", "tz")
TILE, PACK = 16, 4096  # cells per axis of a tile, queries per pack
# Rows of instants or shapes that may be broadcast, some 50 bytes each.
INSTANT_ROWS = 200_000


def linspace_grid(box: DataFrame, n: tuple[int, int, int] = (GRID_N,) * 3) -> DataFrame:
    """``n`` even points per axis between the extents of each row of ``box``."""
    g = box
    for a, count in zip("xyz", n):
        if a == "y":
            g = spread(g, *[c for c in box.columns if c[-3:] not in ("_lo", "_hi")], "ix")
        step = (F.col(f"{a}_hi") - F.col(f"{a}_lo")) / (count - 1)
        g = g.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(
            a, F.col(f"{a}_lo") + F.col(f"i{a}") * step)
    return g.drop(*[f"{a}_{e}" for a in "xyz" for e in ("lo", "hi")])


def step_grid(box: DataFrame, step: float, pad: float = 0.0) -> DataFrame:
    """Points low - pad, then every ``step`` up to high + pad."""
    g = box
    for a in "xyz":
        if a == "y":
            g = spread(g, *[c for c in box.columns if c[-3:] not in ("_lo", "_hi")], "ix")
        count = F.floor((F.col(f"{a}_hi") - F.col(f"{a}_lo") + 2 * pad) / step + 1e-9).cast("int")
        g = g.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), count))).withColumn(
            a, F.col(f"{a}_lo") - pad + F.col(f"i{a}") * step)
    return g.drop(*[f"{a}_{e}" for a in "xyz" for e in ("lo", "hi")])


def voxel_volume(box: DataFrame, n: tuple[int, int, int]) -> DataFrame:
    """Product of range / (n - 1) over the axes."""
    v = F.lit(1.0)
    for a, count in zip("xyz", n):
        v = v * (F.col(f"{a}_hi") - F.col(f"{a}_lo")) / (count - 1)
    return box.withColumn("voxel", v)


def halo_tiles(source: DataFrame, keys: Sequence[str], value: str, edge: int = TILE, extra: Sequence[str] = ()) -> DataFrame:
    """Dense tiles of ``edge`` cells per axis, with the voxels on their upper border: (keys, tx, ty, tz, voxels).

    A cell needs its eight corners, so a tile also holds the next voxel along each axis. Only voxels on a border are sent to more
    than one tile (at most eight): with 16 cells per axis a field travels 1.2 times. ``voxels`` lists place in the tile, value and ``extra``.
    """
    corner = lambda i: F.when((F.col(i) % edge == 0) & (F.col(i) > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    s = source.select(*keys, *VOXEL, F.col(value).cast("double").alias("v"), *extra)
    for i, t in zip(VOXEL, PLACE):
        s = s.withColumn(f"_{t}", F.explode(corner(i)))  # 1: seen from the tile before
    s = s.withColumns({t: (F.floor(F.col(i) / edge) - F.col(f"_{t}")).cast("int") for i, t in zip(VOXEL, PLACE)})
    x, y, z = (F.col(i) - F.col(t) * edge for i, t in zip(VOXEL, PLACE))
    at = ((x * (edge + 1) + y) * (edge + 1) + z).cast("int")
    return s.groupBy(*keys, *PLACE).agg(F.collect_list(F.struct(at.alias("at"), "v", *extra)).alias("voxels"))


def _at_tiles(queries: DataFrame, tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], edge: int) -> tuple[DataFrame, list[str]]:
    """Packs of located queries, each with its tile; the list columns are ``columns``, then cells (within the tile) and offsets."""
    on = [*keys, *PLACE]
    q = queries.withColumns({t: F.floor(F.col(f"c{a}") / edge).cast("int") for a, t in zip("xyz", PLACE)})
    q = q.withColumns({f"c{a}": (F.col(f"c{a}") - F.col(t) * edge).cast("int") for a, t in zip("xyz", PLACE)})
    carry = [*columns, *[f"{p}{a}" for p in "cw" for a in "xyz"]]
    return packed(q.select(*on, *carry), on, ["cx", "cy", "cz"], carry, PACK).join(tiles, on, "left"), carry


def _looked_up(batch: pa.RecordBatch, first: int, side: int, instants: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of packs with their tiles: the packs, the pack of every query, and its weighted corner sums at every instant; offsets outside 0..1 extrapolate.

    Column ``first`` holds the tiles' voxels (place, value and, with several instants, the instant's number), the last six the queries' cells and offsets.
    Packs of many small tiles are looked up together, in an array no larger than their voxels and cells need.
    """
    at, *_ = _fields(batch.columns[first])
    cells = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[-6:-3]]
    if not len(cells[0]):
        return
    size = [int(max(p.max(initial=0), c.max() + 1)) + 1 for p, c in zip(_place(at, side), cells, strict=True)]
    rows = max(1, SLICE * 8 // (int(np.prod(size)) * instants))
    for start in range(0, batch.num_rows, rows):
        for part, row, queries in slices(batch.slice(start, rows), len(batch.columns) - 6, max(1, SLICE // instants)):
            at, v, *k = _fields(part.columns[first])
            held = np.repeat(np.arange(part.num_rows), part.columns[first].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            dense = np.full((part.num_rows, *size, instants), np.nan)
            np.fmax.at(dense, (held, *_place(at, side), k[0] if k else 0), v.astype(float))
            (cx, cy, cz), (wx, wy, wz) = (c.astype(np.int64) for c in queries[:3]), queries[3:]
            out = np.zeros((len(row), instants))
            for a, e, o in CORNERS:
                w = (wx if a else 1 - wx) * (wy if e else 1 - wy) * (wz if o else 1 - wz)
                out += dense[row, cx + a, cy + e, cz + o] * w[:, None]
            yield part, row, out


def _fields(voxels: pa.Array) -> list[np.ndarray]:
    return [f.to_numpy(zero_copy_only=False) for f in voxels.flatten().flatten()]


def _place(at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at // (side * side), at // side % side, at % side


def sampled(queries: DataFrame, tiles: DataFrame, keys: Sequence[str], extra: Sequence[str], columns: Sequence[str], edge: int = TILE) -> DataFrame:
    """Trilinear values of ``tiles`` at located queries: (keys, extra, columns, value), linear continuation outside.

    ``queries`` holds cells ``c*`` and offsets ``w*`` (:func:`located`) and ``columns``; ``extra`` are further keys of ``tiles``, so that
    a query meets each of its tile's instants. The value is NULL where a corner has none; queries without a tile keep one row with NULL.
    Queries travel in packs, a pack meets its tile once, and a sample is a look-up in the tile's array.
    """
    keys, extra, columns = list(keys), list(extra), list(columns)
    j, carry = _at_tiles(queries, tiles, keys, columns, edge)
    nk, n, side = len(keys) + len(extra), len(columns), edge + 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, row, value in _looked_up(b, nk, side):
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in part.columns[:nk]], *[c.flatten() for c in part.columns[nk + 1 : nk + 1 + n]],
                                                  pa.array(value[:, 0], mask=np.isnan(value[:, 0]))], [*keys, *extra, *columns, "value"])

    shape = [types_of(j, [*keys, *extra]), *([types_of(queries, columns)] if columns else []), "value double"]
    return j.select(*keys, *extra, "voxels", *carry).mapInArrow(look_up, ", ".join(shape))


def sampled_series(queries: DataFrame, tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], edge: int = TILE) -> DataFrame:
    """As :func:`sampled`, for tiles that hold all instants: (keys, columns, vs), a value for each of 0 .. ``n`` - 1.

    ``tiles`` have ``k`` among their voxels' extra columns and the number of instants ``n`` as a column. Queries without a tile have no row.
    """
    keys, columns = list(keys), list(columns)
    j, carry = _at_tiles(queries, tiles, keys, columns, edge)
    nk, nc, side = len(keys), len(columns), edge + 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.columns[nk].to_numpy(zero_copy_only=False)
            for count in np.unique(n).tolist():
                for part, row, values in _looked_up(b.filter(pa.array(n == count)), nk + 1, side, int(count)):
                    flat = values.ravel()
                    vs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, count), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in part.columns[:nk]], *[c.flatten() for c in part.columns[nk + 2 : nk + 2 + nc]], vs], [*keys, *columns, "vs"])

    shape = [types_of(j, keys), *([types_of(queries, columns)] if columns else []), "vs array<double>"]
    return j.where(F.col("voxels").isNotNull()).select(*keys, "n", "voxels", *carry).mapInArrow(look_up, ", ".join(shape))


def cell_of(u: Column, n: Column) -> Column:
    """Cell index of grid position ``u``; outside positions use the border cell."""
    return F.greatest(F.lit(0), F.least(F.floor(u).cast("int"), (n - 2).cast("int")))


def grid_shape(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Origin, step and length of each axis of a regular source grid.

    The distinct coordinates of an axis (a few hundred at most) are united map-side.
    """
    aggs = [F.sort_array(F.collect_set(F.col(a).cast("double"))).alias(f"_{a}") for a in "xyz"]
    s = points.groupBy(*keys).agg(*aggs)
    out = []
    for a in "xyz":
        arr, n = F.col(f"_{a}"), F.size(f"_{a}")
        out += [F.array_min(arr).alias(f"{a}0"), ((F.array_max(arr) - F.array_min(arr)) / (n - 1)).alias(f"d{a}"), n.alias(f"n{a}")]
    return s.select(*keys, *out)


def indexed(points: DataFrame, shape: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add integer voxel positions to points of a regular grid."""
    j = points.join(shape, list(keys))
    for a in "xyz":
        j = j.withColumn(f"i{a}", F.round((F.col(a) - F.col(f"{a}0")) / F.col(f"d{a}")).cast("int"))
    return j


def located(queries: DataFrame, shape: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Grid position ``u*``, border-clamped cell ``c*`` and offset ``w*`` of query points."""
    j = queries.join(shape, list(keys))
    for a, c in zip("xyz", (x, y, z)):
        j = j.withColumn(f"u{a}", (F.col(c) - F.col(f"{a}0")) / F.col(f"d{a}"))
        j = j.withColumn(f"c{a}", cell_of(F.col(f"u{a}"), F.col(f"n{a}"))).withColumn(f"w{a}", F.col(f"u{a}") - F.col(f"c{a}"))
    return j


_PLACE = [f"{p}{a}" for a in "xyz" for p in ("u", "c", "w", "d", "n")] + ["x0", "y0", "z0"]


def resample(field: DataFrame, keys: Sequence[str], n: tuple[int, int, int] = (GRID_N,) * 3, margin: float = 0.05,
             shape: DataFrame | None = None, box: DataFrame | None = None) -> DataFrame:
    """Field of a regular source grid on ``n`` points per axis of its widened bounding box.

    Linear inside, linear continuation outside; instants with fewer than four values are dropped.
    ``shape`` and ``box`` may come from the dataset table to save two passes over the field.
    """
    from .field import bounding_box
    keys = list(keys)
    good = field.where(F.col("t_c").isNotNull())
    shape = shape if shape is not None else grid_shape(good, keys)
    box = box if box is not None else bounding_box(good, keys, margin)
    enough = good.groupBy(*keys, "t_idx").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 4").drop("_n")
    source = indexed(good, shape, keys).join(enough, [*keys, "t_idx"], "left_semi")
    tiles = halo_tiles(source, [*keys, "t_idx", "t_min"], "t_c")
    target = located(linspace_grid(box, n), shape, keys)
    out = sampled(target, tiles, keys, ["t_idx", "t_min"], [*VOXEL, "x", "y", "z"]).where("t_idx IS NOT NULL")
    return out.select(*keys, *VOXEL, "x", "y", "z", "t_idx", "t_min", F.col("value").alias("t_c"))


def resampled_series(field: DataFrame, keys: Sequence[str], n: tuple[int, int, int] = (GRID_N,) * 3, margin: float = 0.05, horizon: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C6 and W15 in one: the gridded field as a series per voxel (keys, voxel, x, y, z, ts, vs), and per key its instants ``ts`` and its box.

    The field is shuffled once, into tiles that hold all instants. Instants with fewer than four values, or without a value on the grid, do not
    count; nor do those after the ``horizon``, unless nothing lies before it. Equal times count once.
    """
    from .field import bounding_box
    keys = list(keys)
    good = field.where(F.col("t_c").isNotNull())
    shape, box = cut(grid_shape(good, keys)), cut(bounding_box(good, keys, margin))
    enough = good.groupBy(*keys, "t_idx").agg(F.max("t_min").alias("t_min"), F.count(F.lit(1)).alias("_n")).where("_n >= 4")
    inst = cut(enough.withColumns({"k": F.row_number().over(Window.partitionBy(*keys).orderBy("t_min", "t_idx")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int")}).drop("_n"))
    near = broadcast_if_small(inst, INSTANT_ROWS)
    source = indexed(good.drop("t_min"), broadcast_if_small(shape, INSTANT_ROWS), keys).join(near, [*keys, "t_idx"])
    tiles = halo_tiles(source, [*keys, "n"], "t_c", extra=["k"])
    series = cut(sampled_series(located(linspace_grid(box, n), shape, keys), tiles, keys, [*VOXEL, "x", "y", "z"]))
    seen = series.select(*keys, F.posexplode("vs").alias("k", "v")).where("v IS NOT NULL").select(*keys, "k").distinct()
    times = inst.join(seen, [*keys, "k"])
    if horizon:
        kept = F.col("t_min") <= horizon + 1e-9
        times = times.withColumn("_early", F.max(kept).over(Window.partitionBy(*keys))).where(kept | ~F.col("_early")).drop("_early")
    times = times.groupBy(*keys, "t_min").agg(F.min("k").alias("k")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t_min", "k"))).alias("_t"))
    times = cut(times.select(*keys, F.col("_t.t_min").alias("ts"), F.col("_t.k").alias("ks")))
    out = series.join(broadcast_if_small(times, INSTANT_ROWS), keys).withColumn("vs", F.transform("ks", lambda k: F.get("vs", k))).drop("ks")
    return out, times.drop("ks"), box


def resample_scattered(cloud: DataFrame, keys: Sequence[str], pid: str, n: tuple[int, int, int] = (GRID_N,) * 3, margin: float = 0.05,
                       k: int = 8, power: float = 2.0, box: DataFrame | None = None) -> DataFrame:
    """C6 for clouds whose points differ from instant to instant: inverse-distance mean of the ``k`` nearest values of the instant.

    Every instant is gridded on ``n`` points per axis of the dataset's widened bounding box, over all instants; instants
    with fewer than four values are dropped. A grid point that coincides with points of the cloud has their mean. ``pid`` numbers points and
    breaks ties of distance. Points without a place or value take no part.
    """
    from .field import bounding_box
    from .octree import nearest, placed
    keys, (_, ny, nz) = list(keys), n
    good = cut(placed(cloud.where(F.col("t_c").isNotNull())).select(*keys, "t_idx", "t_min", pid, "x", "y", "z", "t_c"))
    box = cut(box if box is not None else bounding_box(good, keys, margin))
    enough = cut(good.groupBy(*keys, "t_idx").agg(F.max("t_min").alias("t_min"), F.count(F.lit(1)).alias("_n")).where("_n >= 4").drop("_n"))
    target = linspace_grid(box, n).withColumn("_q", (F.col("ix") * ny + F.col("iy")) * nz + F.col("iz"))
    near = nearest(target.join(enough.select(*keys, "t_idx"), keys), good, [*keys, "t_idx"], "_q", pid, k, "t_c")
    on, w = F.col("distance") <= 1e-9, F.pow("distance", F.lit(-power))
    mean = F.coalesce(F.avg(F.when(on, F.col("t_c"))), F.sum(F.when(~on, w * F.col("t_c"))) / F.sum(F.when(~on, w)))
    out = near.groupBy(*keys, "t_idx", "_q").agg(mean.alias("t_c")).join(enough, [*keys, "t_idx"]).join(box, keys)
    place = {"ix": F.floor(F.col("_q") / (ny * nz)), "iy": F.floor(F.col("_q") / nz) % ny, "iz": F.col("_q") % nz}
    out = out.withColumns({i: c.cast("int") for i, c in place.items()})
    out = out.withColumns({a: F.col(f"{a}_lo") + F.col(f"i{a}") * ((F.col(f"{a}_hi") - F.col(f"{a}_lo")) / (count - 1)) for a, count in zip("xyz", n)})
    return out.select(*keys, *VOXEL, "x", "y", "z", "t_idx", "t_min", "t_c")


def sample_mask(points: DataFrame, voxels: DataFrame, shape: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Nearest voxel of an occupancy mask; outside the grid is empty."""
    j = points.join(shape, list(keys))
    for a, c in zip("xyz", (x, y, z)):
        j = j.withColumn(f"u{a}", (F.col(c) - F.col(f"{a}0")) / F.col(f"d{a}"))
    out = F.lit(False)
    for a in "xyz":
        out = out | (F.col(f"u{a}") < 0) | (F.col(f"u{a}") > F.col(f"n{a}") - 1)
        j = j.withColumn(f"i{a}", F.floor(F.col(f"u{a}") + 0.5).cast("int"))
    occ = voxels.where("occ").select(*keys, *VOXEL, F.lit(True).alias("_in"))
    j = j.withColumn("_out", out).join(occ, [*keys, *VOXEL], "left")
    return j.withColumn("inside", ~F.col("_out") & F.coalesce("_in", F.lit(False))).drop("_in", "_out", *[f"u{a}" for a in "xyz"])


def sample_distance(points: DataFrame, tiles: DataFrame, shape: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Trilinear signed distance from ``halo_tiles``; 1e6 outside the grid; inside when negative."""
    out = F.lit(False)
    for a in "xyz":
        out = out | (F.col(f"u{a}") < 0) | (F.col(f"u{a}") > F.col(f"n{a}") - 1)
    rest = [c for c in points.columns if c not in keys]
    j = located(points, shape, keys, x, y, z).withColumn("_out", out)
    d = F.when(F.col("_out"), F.lit(1e6)).otherwise(F.coalesce("value", F.lit(1e6)))
    return sampled(j, tiles, keys, [], [*rest, "_out"]).withColumn("distance", d).drop("value", "_out").withColumn("inside", F.col("distance") < 0)


def instants(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ts): the instants of each dataset in order; their number is the study's, whatever the number of voxels."""
    return field.select(*keys, "t_min").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("t_min")).alias("ts"))


def trailing(field: DataFrame, keys: Sequence[str], k: int = TRAIL) -> DataFrame:
    """Rows of the last ``k`` instants of their dataset, with its last instant, the voxel's value there and the time before it.

    A voxel without a value at the dataset's last instant has a NULL ``a``.
    """
    last = instants(field, keys).select(*keys, F.element_at("ts", -1).alias("t_end"), F.get("ts", F.greatest(F.size("ts") - k, F.lit(0))).alias("_from"))
    f = field.join(last, list(keys))
    at_end = F.max(F.when(F.col("t_min") == F.col("t_end"), F.col("t_c"))).over(Window.partitionBy(*keys, *VOXEL))
    return f.withColumn("a", at_end).where("t_min >= _from").drop("_from").withColumn("tau", F.col("t_min") - F.col("t_end"))


def future_minutes(t_end: Column, horizon: Column | float) -> Column:
    """Whole minutes after the last instant up to the horizon, as an array (empty when there are none)."""
    first = (F.floor(t_end + 1e-9) + 1).cast("int")
    last = F.floor((horizon if isinstance(horizon, Column) else F.lit(horizon)) + 1e-9).cast("int")
    whole = F.when(last >= first, F.sequence(first, F.greatest(first, last)))
    return F.transform(whole, lambda m: m.cast("double"))


def voxel_series(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per voxel: the instants ``ts`` of its dataset and its values ``vs`` at them, NULL where it has none."""
    per = field.groupBy(*keys, *VOXEL).agg(F.collect_list(F.struct("t_min", "t_c")).alias("_p"))
    value = lambda t: F.get(F.filter("_p", lambda p: p["t_min"] == t), 0)["t_c"]
    return per.join(instants(field, keys), list(keys)).select(*keys, *VOXEL, "ts", F.transform("ts", value).alias("vs"))


def with_trends(series: DataFrame, k: int = TRAIL) -> DataFrame:
    """Both local trends of each series from its last ``k`` instants: line (slope, rmse, sxx) and weighted quadratic (b, c, span, rmse_q).

    All of them are NULL if a value of the window is missing, as is the line of a single instant.
    """
    total = lambda e: f"aggregate(win, 0D, (s, x) -> s + {e})"
    moment = lambda p, v="1D": total(f"x.w * pow(x.tau, {p}D) * {v}")
    m, det = "(s2 + 1e-8)", "(s0 * ((s2 + 1e-8) * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - (s2 + 1e-8) * s2))"
    steps = [
        {"t_end": "element_at(ts, -1)", "a": "element_at(vs, -1)", "_n": f"least({k}, size(ts))"},
        {"_ts": "slice(ts, size(ts) - _n + 1, _n)", "_vs": "slice(vs, size(vs) - _n + 1, _n)"},
        {"_gap": "exists(_vs, v -> v is null)", "span": "greatest(2.220446049250313e-16D, t_end - _ts[0])"},
        {"win": "if(_gap, null, zip_with(_ts, _vs, (t, v) -> named_struct('tau', t - t_end, 'v', v, 'w', pow(greatest(1 - pow(abs((t - t_end) / span), 3D), 0D), 3D))))"},
        {"sxx": total("x.tau * x.tau")},
        {"slope": f"if(sxx > 0, {total('(x.v - a) * x.tau')} / sxx, null)"} | {f"s{p}": moment(p) + (" + 1e-8D" if p in (0, 4) else "") for p in range(5)} | {f"r{p}": moment(p, "x.v") for p in range(3)},
        # the ridge also sits on the middle diagonal entry; s2 appears there and off the diagonal
        {"b": f"(s0 * (r1 * s4 - s3 * r2) - r0 * (s1 * s4 - s3 * s2) + s2 * (s1 * r2 - r1 * s2)) / {det}", "c": f"(s0 * ({m} * r2 - r1 * s3) - s1 * (s1 * r2 - r1 * s2) + r0 * (s1 * s3 - {m} * s2)) / {det}"},
        {"rmse": f"sqrt({total('pow(x.v - a - slope * x.tau, 2D)')} / _n)", "rmse_q": f"sqrt({total('x.w * pow(x.v - a - b * x.tau - c * x.tau * x.tau, 2D)')} / {total('x.w')})"},
    ]
    out = series
    for step in steps:
        out = out.withColumns({n: F.expr(e) for n, e in step.items()})
    return out.drop("_n", "_ts", "_vs", "_gap", "win", *[f"s{p}" for p in range(5)], *[f"r{p}" for p in range(3)])


def _line(dt: Column) -> tuple[Column, Column]:
    return F.col("a") + F.col("slope") * dt, F.col("rmse") * F.sqrt(1 + dt * dt / F.col("sxx"))


def _quadratic(dt: Column) -> tuple[Column, Column]:
    return F.col("a") + F.col("b") * dt + F.col("c") * dt * dt, F.col("rmse_q") * (1 + F.abs(dt) / F.col("span"))


def _ahead(trends: DataFrame, keys: Sequence[str], horizon: Column | float, ways: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    out = trends.withColumn("t_min", F.explode(future_minutes(F.col("t_end"), horizon)))
    value, sigma = ways(F.col("t_min") - F.col("t_end"))
    return out.select(*keys, *VOXEL, "t_min", value.alias("t_c"), sigma.alias("sigma"))


def linear_trend(field: DataFrame, keys: Sequence[str], horizon: Column | float, k: int = TRAIL) -> DataFrame:
    """Line through the dataset's last instant with least-squares slope; spread grows with the time ahead."""
    return _ahead(with_trends(voxel_series(field, keys), k), keys, horizon, _line)


def local_quadratic(field: DataFrame, keys: Sequence[str], horizon: Column | float, k: int = TRAIL) -> DataFrame:
    """Tricube-weighted quadratic of the trailing window, its intercept replaced by the last value."""
    return _ahead(with_trends(voxel_series(field, keys), k), keys, horizon, _quadratic)


def centred(series: DataFrame) -> DataFrame:
    """Voxel values minus their mean over time, gaps as zero."""
    known = F.filter("vs", lambda v: v.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))
    return series.withColumn("mean", mean).withColumn("cs", F.transform("vs", lambda v: F.coalesce(v - F.col("mean"), F.lit(0.0))))


def time_gram(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time-by-time product matrix of each dataset, as rows (keys, i, j, g).

    Every task first multiplies its own batch and emits at most nt x nt rows per dataset, then
    the partial matrices are summed, so a dataset with most of the voxels stays spread out.
    """
    keys = list(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.zeros(b.num_rows, np.int64)
            for c in b.columns[:-1]:
                codes = np.unique(codes * b.num_rows + c.dictionary_encode().indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []
            ends, flat = b.columns[-1].offsets.to_numpy(), b.columns[-1].values.to_numpy()
            done: list[tuple[int, np.ndarray]] = []
            for rows in groups:
                length = int(ends[rows[0] + 1] - ends[rows[0]])  # all series of a dataset have its instants
                x = flat[ends[rows][:, None] + np.arange(length)]
                done.append((int(rows[0]), x.T @ x))
                if done[-1][1].size * len(done) >= SLICE:
                    yield rows_of(b, done)
                    done = []
            if done:
                yield rows_of(b, done)

    def rows_of(b: pa.RecordBatch, done: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        at = pa.array(np.repeat([r for r, _ in done], [g.size for _, g in done]))
        i, j = (np.concatenate(a) for a in zip(*[[p.ravel() for p in np.indices(g.shape, np.int32)] for _, g in done]))
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:-1]], pa.array(i), pa.array(j), pa.array(np.concatenate([g.ravel() for _, g in done]))], [*keys, "i", "j", "g"])

    parts = series.dropna(subset=keys).select(*keys, "cs").mapInArrow(partial, f"{types_of(series, keys)}, i int, j int, g double")
    return parts.groupBy(*keys, "i", "j").agg(F.sum("g").alias("g"))


def pca_direction(gram: DataFrame, last_times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per dataset the vector that maps a centred series to its slope along the leading modes.

    The group is one nt x nt matrix. Leading modes hold 99 % of the energy, at least three
    (or as many as there are); the result does not depend on the signs of the eigenvectors.
    """
    keys = list(keys)

    def solved(entries: pa.StructScalar, step: float | None) -> tuple[int, float, list[float]]:
        i, j, values = (f.to_numpy() for f in entries.values.flatten())
        n = int(i.max()) + 1
        g = np.zeros((n, n))
        g[i, j] = values
        values, modes = np.linalg.eigh((g + g.T) / 2)
        values, modes = np.clip(values[::-1], 0, None), modes[:, ::-1]
        total = values.sum()
        rank = 1
        if total > np.finfo(float).eps:
            rank = min(n, max(int(np.argmax(np.cumsum(values) / total >= ENERGY)) + 1, min(3, n)))
        v = modes[:, :rank]
        rate = (v[-1] - v[-2]) / step if n > 1 and step is not None and step > 0 else np.zeros(rank)
        kept = float(values[:rank].sum() / total) if total > np.finfo(float).eps else 1.0
        return rank, kept, (v @ rate).tolist()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *by, step, matrix = b.columns
            rows = [solved(m, s) for m, s in zip(matrix, step.to_pylist(), strict=True)]
            shape = [pa.int32(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([*by, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(shape)]], [*keys, "rank", "energy", "direction"])

    matrices = gram.join(last_times, keys).groupBy(*keys).agg(F.max("step").alias("step"), F.collect_list(F.struct("i", "j", "g")).alias("_g"))
    return spread(matrices, *keys).mapInArrow(solve, f"{types_of(gram, keys)}, rank int, energy double, direction array<double>")


def _with_rate(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``series`` (centred) with its slope along the leading modes of its dataset.

    Extending every mode by its last difference and shifting the result to the last value equals
    T_end + dt * (centred series . direction), so a voxel needs one small vector of its dataset.
    """
    keys = list(keys)
    times = series.groupBy(*keys).agg(F.max(F.element_at("ts", -1) - F.try_element_at("ts", F.lit(-2))).alias("step"))
    d = pca_direction(time_gram(series, keys), times, keys)
    dot = F.aggregate(F.zip_with("cs", "direction", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return series.join(d, keys).withColumn("rate", dot)


def pca_trend(field: DataFrame, keys: Sequence[str], horizon: Column | float) -> DataFrame:
    """Temporal PCA extrapolation; NULL for a voxel without a value at the dataset's last instant."""
    s = cut(centred(voxel_series(field, keys)))
    j = _with_rate(s, keys).withColumns({"a": F.element_at("vs", -1), "t_end": F.element_at("ts", -1)})
    j = j.withColumn("t_min", F.explode(future_minutes(F.col("t_end"), horizon)))
    return j.select(*keys, *VOXEL, "t_min", (F.col("a") + (F.col("t_min") - F.col("t_end")) * F.col("rate")).alias("t_c"))


def extrapolations(field: DataFrame, keys: Sequence[str], horizon: Column | float) -> DataFrame:
    """A14-A16 together: rows (keys, voxel, t_min, method, t_c, sigma). The field is shuffled once, into series that all methods read."""
    keys = list(keys)
    j = with_trends(_with_rate(cut(centred(voxel_series(field, keys))), keys)).withColumn("t_min", F.explode(future_minutes(F.col("t_end"), horizon)))
    return j.select(*keys, *VOXEL, "t_min", F.inline(_ways(F.col("t_min"))))


def _ways(t: Column) -> Column:
    """(method, t_c, sigma) of the three methods at a future time."""
    dt = t - F.col("t_end")
    (line, s_line), (bend, s_bend) = _line(dt), _quadratic(dt)
    ways = [("gradiente_local", line, s_line), ("lowess_cuadratico", bend, s_bend), (DEFAULT_METHOD, F.col("a") + dt * F.col("rate"), (s_line + s_bend) / 2)]
    return F.array(*[F.struct(F.lit(n).alias("method"), v.alias("t_c"), e.alias("sigma")) for n, v, e in ways])


def extended(series: DataFrame, keys: Sequence[str], horizon: float | None, source: str) -> DataFrame:
    """Series as rows (keys, voxel, x, y, z, t_base, method, t_min, t_c, sigma): their own instants as method ``source``, then the
    whole minutes up to the horizon by all three methods. Series are not shuffled; only products of time by time are summed."""
    keys = list(keys)
    j = with_trends(_with_rate(cut(centred(series)), keys)) if horizon else series
    own = F.transform(F.arrays_zip("ts", "vs"), lambda p: F.struct(p["ts"].alias("t_min"), F.lit(source).alias("method"), p["vs"].alias("t_c"), F.lit(None).cast("double").alias("sigma")))
    rows = own
    if horizon:
        ahead = F.transform(future_minutes(F.col("t_end"), horizon), lambda t: F.transform(_ways(t), lambda w: F.struct(t.alias("t_min"), w["method"].alias("method"), w["t_c"].alias("t_c"), w["sigma"].alias("sigma"))))
        rows = F.concat(own, F.coalesce(F.flatten(ahead), F.slice(own, 1, 0)))
    return j.select(*keys, *VOXEL, "x", "y", "z", F.get("vs", F.lit(0)).alias("t_base"), F.inline(rows))


# Names under which the three methods are asked for.
METHODS = {"Gradiente local": "gradiente_local", "LOWESS": "lowess_cuadratico"}
DEFAULT_METHOD = "pca_temporal"


def chosen_method(extrapolated: DataFrame, strategy: str) -> DataFrame:
    """Rows of the asked method; anything else means temporal PCA."""
    return extrapolated.where(F.col("method") == METHODS.get(strategy, DEFAULT_METHOD))


def chosen_field(df: DataFrame, wanted: str = "corrected") -> DataFrame:
    """Corrected or base value with the other as fallback."""
    order = ("t_corr", "t_c") if wanted == "corrected" else ("t_c", "t_corr")
    return df.withColumn("t_shown", F.coalesce(*order))


def segment_label(t: Column, last_source: Column) -> Column:
    """Instants after the last source time are extrapolated."""
    return F.when(t > last_source + 1e-9, F.lit("extrapolado")).otherwise(F.lit("fuente"))


def central_index(n: Column, cap: int | None = None) -> Column:
    """Zero-based middle of an axis of length ``n``, or of at most ``cap`` evenly taken positions of it."""
    taken = n if cap is None else F.least(n, F.lit(cap))
    k = F.greatest(F.lit(1), F.floor(taken / 2 + 0.5))
    exact = k if cap is None else F.when(n > cap, F.floor(1 + (n - 1) * (k - 1) / (cap - 1) + 0.5)).otherwise(k)
    return (exact - 1).cast("int")


def plane_slices(field: DataFrame, shape: DataFrame, keys: Sequence[str], t_idx: int, cap: int | None = None) -> DataFrame:
    """The three central planes at one instant; both filters reach the scan or the join row.

    A viewer that shows few lines per axis asks for ``cap`` of them (AXIS_CAP); by default all are kept.
    """
    j = field.where(F.col("t_idx") == t_idx).join(shape.select(*keys, *[f"n{a}" for a in "xyz"]), list(keys))

    def kept(i: str, n: str) -> Column:
        if cap is None:
            return F.lit(True)
        near = 1 + F.round(F.col(i) * (cap - 1) / (F.col(n) - 1)) * (F.col(n) - 1) / (cap - 1)
        return (F.col(n) <= cap) | (F.col(i) == F.floor(near + 0.5) - 1)

    plane = lambda name, a, n, p, q: F.when(
        (F.col(a) == central_index(F.col(n), cap)) & kept(*p) & kept(*q), F.lit(name))
    x, y, z = ("ix", "nx"), ("iy", "ny"), ("iz", "nz")
    names = F.array_compact(F.array(plane("xy", "iz", "nz", x, y), plane("xz", "iy", "ny", x, z), plane("yz", "ix", "nx", y, z)))
    return j.withColumn("plane", F.explode(names)).select(*keys, "plane", *VOXEL, "t_c")


def evaluate(field: DataFrame, queries: DataFrame, shape: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """C11: field at free points and times: linear in time, then in space.

    ``queries`` holds (ids, keys, x, y, z, t). The bracketing instants come from one sorted
    look-up per dataset over instants and query times.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("t_min")
    inst = field.groupBy(*keys, "t_idx").agg(F.max("t_min").alias("t_min")).withColumns({
        "i1": F.lead("t_idx").over(w), "t1": F.lead("t_min").over(w), "i_": F.lag("t_idx").over(w), "t_": F.lag("t_min").over(w)})
    piece = F.when(F.col("i1").isNotNull(), F.struct(F.col("t_idx").alias("ia"), F.col("t_min").alias("ta"), F.col("i1").alias("ib"), F.col("t1").alias("tb"))) \
        .otherwise(F.struct(F.col("i_").alias("ia"), F.col("t_").alias("ta"), F.col("t_idx").alias("ib"), F.col("t_min").alias("tb")))
    left = inst.select(*keys, F.col("t_min").alias("_t"), F.lit(0).alias("_kind"), piece.alias("seg"))
    right = queries.select(*keys, F.col("t").cast("double").alias("_t"), F.lit(1).alias("_kind"), F.struct(*queries.columns).alias("_row"))
    seen = carried(left.unionByName(right, allowMissingColumns=True), keys, "_t", ["_kind"], {"_seg": "seg"}).where("_kind = 1")
    q = located(seen.select("_row.*", "_seg"), shape, keys)
    ends = q.withColumn("_e", F.explode(F.array(
        F.struct(F.col("_seg.ia").alias("t_idx"), ((F.col("_seg.tb") - F.col("t")) / (F.col("_seg.tb") - F.col("_seg.ta"))).alias("wt")),
        F.struct(F.col("_seg.ib").alias("t_idx"), ((F.col("t") - F.col("_seg.ta")) / (F.col("_seg.tb") - F.col("_seg.ta"))).alias("wt"))))) \
        .withColumns({"t_idx": F.col("_e.t_idx"), "wt": F.col("_e.wt")})
    tiles = halo_tiles(field, [*keys, "t_idx"], "t_c")
    found = sampled(ends, tiles, [*keys, "t_idx"], [], [*ids, "wt"])
    value = F.col("wt") * F.col("value")
    return found.groupBy(*keys, *ids).agg(F.when(F.count(value) == 2, F.sum(value)).alias("t_eval"))


def largest_extent(shapes: DataFrame, margin: float = 5.0) -> DataFrame:
    """Largest absolute end of any axis of the selected grids, plus a margin."""
    ends = []
    for a in "xyz":
        ends += [F.abs(F.col(f"{a}0")), F.abs(F.col(f"{a}0") + F.col(f"d{a}") * (F.col(f"n{a}") - 1))]
    return shapes.agg((F.max(F.greatest(*ends)) + margin).alias("radius_max"))
