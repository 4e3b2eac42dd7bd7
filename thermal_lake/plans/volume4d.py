"""Four-dimensional volume analysis, from the raw field or a stored grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import field as FL
from ..operators import grid as GR
from ..operators.skew import broadcast_if_small

ORIGINAL = "fuente"


def from_field(field: DataFrame, keys: Sequence[str], horizon: float, n: tuple[int, int, int] = (GR.GRID_N,) * 3, t_abl: float = FL.T_ABL_VOLUME,
               correction: tuple[DataFrame, DataFrame, DataFrame] | None = None, ssa: DataFrame | None = None, margin: float = 0.05,
               intensity: float = 1.0, cap_c: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw field to gridded, extended and corrected field, and its volume curves, as one job.

    The field (regular source grid, with NULL gaps) is shuffled once, into tiles of all instants; from there on a voxel is one row
    with its series: gridding, the three extrapolations, the correction and the counts of the curves are expressions over it, and only
    small sums travel. ``correction`` is (pairs (keys, corr_id), zones, knots). Datasets with fewer than two instants are left out.

    Returns rows (keys, [corr_id], voxel, x, y, z, t_base, method, t_min, t_c, sigma, [t_corr]) and curves
    (keys, [corr_id], method, t_min, sigma, volume, [volume_corr]).
    """
    keys = list(keys)
    series, times, box = GR.resampled_series(field, keys, n, margin, horizon)
    rows = GR.extended(series.where(F.size("ts") >= 2), keys, horizon, ORIGINAL)
    voxel = GR.voxel_volume(box, n).select(*keys, "voxel")
    counts = {"volume": F.count_if(F.col("t_c") >= t_abl)}
    by = list(keys)
    if correction is not None:
        pairs, zones, knots = correction
        future = GR.future_minutes(F.element_at("ts", -1), horizon) if horizon else None
        every = times.select(*keys, F.explode(F.concat("ts", F.coalesce(future, F.slice("ts", 1, 0))) if horizon else F.col("ts")).alias("t_min"))
        need = pairs.join(every, keys).select("corr_id", "t_min").distinct()
        plan = FL.zone_plan(zones, FL.factor_table(zones, knots, need, ssa), intensity, True, cap_c)
        rows = FL.correct(rows.join(broadcast_if_small(pairs, GR.INSTANT_ROWS), keys), plan, ["corr_id", "t_min"]).drop("cap", "t_rel")
        counts["volume_corr"] = F.count_if(F.col("t_corr") >= t_abl)
        by.append("corr_id")
    curve = rows.groupBy(*by, "method", "t_min").agg(F.avg("sigma").alias("sigma"), *[c.alias(name) for name, c in counts.items()]).join(voxel, keys)
    return rows, curve.withColumns({name: F.col(name) * F.col("voxel") for name in counts}).drop("voxel")


def analyse(grid_field: DataFrame, keys: Sequence[str], horizon: float, voxel: DataFrame, t_abl: float = FL.T_ABL_VOLUME) -> tuple[DataFrame, DataFrame]:
    """The gridded field extended by all three methods, and its uncorrected volume curves.

    ``grid_field`` is the output of ``grid.resample`` (or a stored grid); ``voxel`` gives the
    voxel volume per key. Without a horizon beyond the data only source rows come back.
    """
    keys = list(keys)
    f = FL.within_horizon(grid_field, horizon, keys) if horizon and horizon > 0 else grid_field
    source = f.select(*keys, *GR.VOXEL, "t_min", F.lit(ORIGINAL).alias("method"), "t_c", F.lit(None).cast("double").alias("sigma"))
    full = source
    if horizon and horizon > 0:
        full = source.unionByName(GR.extrapolations(f, keys, horizon))
    return full, curves(full, keys, voxel, t_abl)


def curves(full: DataFrame, keys: Sequence[str], voxel: DataFrame, t_abl: float = FL.T_ABL_VOLUME, value: str = "t_c") -> DataFrame:
    """Volume above the threshold and mean spread per method and time."""
    keys = list(keys)
    v = full.groupBy(*keys, "method", "t_min").agg(F.count_if(F.col(value) >= t_abl).alias("_n"), F.avg("sigma").alias("sigma"))
    return v.join(voxel, keys).withColumn("volume", F.col("_n") * F.col("voxel")).drop("_n", "voxel")


def apply_correction(full: DataFrame, keys: Sequence[str], pairs: DataFrame, zones: DataFrame, knots: DataFrame, ssa: DataFrame | None = None,
                     intensity: float = 1.0, cap_c: float | None = None) -> DataFrame:
    """(re)apply a correction to a stored grid; dropping ``t_corr`` removes it again. No re-gridding.

    ``full`` holds (keys, voxel, z, t_min, method, t_c); the base is the first source value.
    """
    keys = list(keys)
    base = full.where(F.col("method") == ORIGINAL).groupBy(*keys, *GR.VOXEL).agg(F.min_by("t_c", "t_min").alias("t_base"))
    need = pairs.join(full.select(*keys, "t_min").distinct(), keys).select("corr_id", "t_min").distinct()
    plan = FL.zone_plan(zones, FL.factor_table(zones, knots, need, ssa), intensity, True, cap_c)
    return FL.correct(full.join(base, [*keys, *GR.VOXEL]).join(pairs, keys), plan, ["corr_id", "t_min"])
