"""Point fields: domain and temperature filters, statistics, zones, the thermal correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numerics
from ..functions.nulls import finite
from ..schemas import SSA
from .curves import pchip
from ..session import cut
from .skew import broadcast_if_small, ranked

DATASET = ("modelo", "dataset")
# Default thresholds (degrees C), domain (mm) and zone depths (mm).
T_ABL_EXTRACT, T_ABL_VOLUME, T_CORRECTED_MAX = 55.0, 60.0, 120.0
RADIUS_MM, Z_LOW_MM, Z_HIGH_MM = 50.0, 0.0, 45.0
ZONE_DEPTHS_SIM = (18.6, 25.2, 31.8, 38.4)
ZONE_DEPTHS_EXP = (26.4, 19.8, 13.2, 6.6)
KELVIN = 273.15
# A plan row is a few bands (well under 1 kB), so this bounds the broadcast to tens of MB.
PLAN_BROADCAST_ROWS = 50_000


def in_cylinder(x: Column, y: Column, z: Column, radius: float = RADIUS_MM, z0: float = Z_LOW_MM, z1: float = Z_HIGH_MM) -> Column:
    """inside the extraction cylinder, 1e-9 tolerance; an inverted domain holds nothing."""
    tol = 1e-9
    if not z1 > z0 or not radius > 0:
        return F.lit(False)
    return (F.hypot(x, y) <= radius + tol) & (z >= z0 - tol) & (z <= z1 + tol)


def domain_limits(field: DataFrame, keys: Sequence[str] = DATASET, radius: float = RADIUS_MM, z0: float = Z_LOW_MM,
                  z1: float = Z_HIGH_MM) -> DataFrame:
    """domain clipped to the bounding box of each dataset; empty ones are dropped."""
    b = bounding_box(field, keys)
    out = b.select(*keys, F.greatest("x_lo", F.lit(-radius)).alias("x_lo"), F.least("x_hi", F.lit(radius)).alias("x_hi"),
                   F.greatest("y_lo", F.lit(-radius)).alias("y_lo"), F.least("y_hi", F.lit(radius)).alias("y_hi"),
                   F.greatest("z_lo", F.lit(z0)).alias("z_lo"), F.least("z_hi", F.lit(z1)).alias("z_hi"))
    return out.where("x_hi > x_lo AND y_hi > y_lo AND z_hi > z_lo")


def temperature_window(field: DataFrame, low: Column, high: Column, keys: Sequence[str] = (*DATASET, "t_idx"),
                       at_least: int = 4) -> DataFrame:
    """points with low <= T <= high, of instants that keep at least four such points.

    The per-instant count is aggregated map-side and joined back; an instant with a third of
    all points is neither sorted nor gathered.
    """
    kept = field.where(F.col("t_c").between(low, high))
    enough = kept.groupBy(*keys).count().where(F.col("count") >= at_least).select(*keys)
    return kept.join(enough, list(keys), "left_semi")


def ablated(t: Column, configured: Column | None = None, stored: Column | None = None, default: float = T_ABL_VOLUME) -> Column:
    """at or above the first known threshold."""
    options = [c for c in (configured, stored) if c is not None]
    return t >= F.coalesce(*options, F.lit(default))


def to_celsius(df: DataFrame, series: Sequence[str], value: str = "t_c") -> DataFrame:
    """Series whose smallest value exceeds 200 are kelvin."""
    low = df.groupBy(*series).agg((F.min(value) > 200).alias("_k"))
    return df.join(low, list(series)).withColumn(
        value, F.when(F.col("_k"), F.col(value) - KELVIN).otherwise(F.col(value))).drop("_k")


def to_minutes(df: DataFrame, series: Sequence[str], t: str = "t", name: str = "t_min") -> DataFrame:
    """Unit by the largest time: above 5000 milliseconds, above 60 seconds, else minutes."""
    top = df.groupBy(*series).agg(F.max(t).alias("_top"))
    return df.join(top, list(series)).withColumn(
        name, F.when(F.col("_top") > 5000, F.col(t) / 1000 / 60).when(F.col("_top") > 60, F.col(t) / 60)
        .otherwise(F.col(t))).drop("_top")


def time_fallback(df: DataFrame, keys: Sequence[str], idx: str, sources: Sequence[str], name: str = "t_min") -> DataFrame:
    """The first source with any time; spread evenly if it does not cover every index, else 0, 1, 2 ..."""
    k = [F.count(s).alias(f"_n_{s}") for s in sources]
    k += [F.min_by(s, F.when(F.col(s).isNotNull(), F.col(idx))).alias(f"_a_{s}") for s in sources]
    k += [F.max_by(s, F.when(F.col(s).isNotNull(), F.col(idx))).alias(f"_b_{s}") for s in sources]
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(idx).alias("_i0"), *k)
    j = df.join(stats, list(keys))
    pos = F.col(idx) - F.col("_i0")
    out = None
    for s in sources:
        spread = F.col(f"_a_{s}") + (F.col(f"_b_{s}") - F.col(f"_a_{s}")) * pos / F.greatest(F.lit(1), F.col("_n") - 1)
        value = F.when(F.col(f"_n_{s}") == F.col("_n"), F.col(s)).otherwise(spread)
        hit = F.col(f"_n_{s}") > 0
        out = F.when(hit, value) if out is None else out.when(hit, value)
    out = out.otherwise(pos.cast("double"))
    return j.withColumn(name, out).drop("_n", "_i0", *[f"_{p}_{s}" for s in sources for p in "nab"])


def probe_coordinate(*aliases: Column) -> Column:
    """The first alias holding three finite numbers; NULL means global correction.

    Each alias is an array column.
    """
    good = lambda a: F.when((F.size(a) >= 3) & F.forall(F.slice(a, 1, 3), lambda v: finite(v).isNotNull()), F.slice(a, 1, 3))
    return F.coalesce(*[good(a) for a in aliases])


def instant_stats(field: DataFrame, keys: Sequence[str] = (*DATASET, "t_idx"), value: str = "t_c",
                  t_abl: Column | float = T_ABL_EXTRACT, t_carbon: Column | float = 300.0) -> DataFrame:
    """A1: minimum, maximum and counts of one instant over finite points."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    t = F.col(value)
    return field.where(t.isNotNull()).groupBy(*keys).agg(
        F.min(t).alias("t_min_c"), F.max(t).alias("t_max_c"), F.count(t).alias("n_total"),
        F.count_if(t >= lit(t_abl)).alias("n_filtered"), F.count_if(t >= lit(t_carbon)).alias("n_carbon"))


def volume_curve(field: DataFrame, voxel: Column | float, threshold: Column | float = T_ABL_VOLUME, value: str = "t_c",
                 keys: Sequence[str] = (*DATASET, "t_idx")) -> DataFrame:
    """A2: number of points at or above the threshold times the voxel volume."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return field.groupBy(*keys).agg(F.count_if(F.col(value) >= lit(threshold)).alias("_n")).withColumn(
        "volume", F.col("_n") * lit(voxel)).drop("_n")


def axis_steps(field: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """A3: median positive step of the distinct coordinates per axis, 1 for a single value."""
    axes = field.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for a in "xyz"])).alias("p")).select(*keys, "p.*").distinct()
    w = Window.partitionBy(*keys, "axis").orderBy("v")
    step = axes.withColumn("d", F.col("v") - F.lag("v").over(w)).groupBy(*keys, "axis").agg(
        F.coalesce(F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(1.0)).alias("step"))
    return step.groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == a, F.col("step"))).alias(f"d{a}") for a in "xyz"])


def bounding_box(points: DataFrame, keys: Sequence[str] = DATASET, margin: float = 0.0) -> DataFrame:
    """A4: six extents, widened by ``margin`` of each range."""
    aggs = [f(a).cast("double").alias(f"_{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    b = points.groupBy(*keys).agg(*aggs)
    ends = []
    for a in "xyz":
        lo, hi = F.col(f"_lo_{a}"), F.col(f"_hi_{a}")
        ends += [(lo - margin * (hi - lo)).alias(f"{a}_lo"), (hi + margin * (hi - lo)).alias(f"{a}_hi")]
    return b.select(*keys, *ends)


def content_signature(df: DataFrame, keys: Sequence[str], columns: Sequence[str], parameters: str = "") -> DataFrame:
    """A5: digest of count, minimum, maximum and exact decimal sum of each column, plus parameters.

    Decimal sums do not depend on the order in which partitions are added, so the digest is
    the same on every run.
    """
    dec = lambda c: c.cast("decimal(28,6)")
    parts = [F.count(F.lit(1)).cast("string").alias("_n")]
    for c in columns:
        parts += [F.count(c).cast("string").alias(f"_c_{c}"), dec(F.min(c)).cast("string").alias(f"_a_{c}"),
                  dec(F.max(c)).cast("string").alias(f"_b_{c}"), F.sum(dec(F.col(c))).cast("decimal(38,6)").cast("string").alias(f"_s_{c}")]
    t = df.groupBy(*keys).agg(*parts)
    names = [c for c in t.columns if c not in keys]
    return t.select(*keys, F.sha2(F.concat_ws("|", F.lit(parameters), *[F.coalesce(c, F.lit("-")) for c in names]), 256).alias("signature"))


def adaptive_radius(points: DataFrame, keys: Sequence[str], radius: float = 0.0) -> DataFrame:
    """The given radius if positive, else from the mean spacing of the cloud."""
    eps = 2.220446049250313e-16
    b = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[(F.max(a) - F.min(a) + eps).alias(f"_{a}") for a in "xyz"])
    auto = F.greatest(F.lit(2.0), 2.2 * F.cbrt(F.col("_x") * F.col("_y") * F.col("_z") / F.col("_n")))
    return b.select(*keys, (F.lit(radius) if radius > 0 else auto).alias("radius"))


def zone_edges(depths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges halfway between consecutive depths, open at both ends (NULL).

    ``depths`` holds (keys, zone_id, depth); a correction has at most a few zones.
    """
    w = Window.partitionBy(*keys).orderBy("zone_id")
    before, after = F.lag("depth").over(w), F.lead("depth").over(w)
    return depths.withColumns({
        "z_min": (before + F.col("depth")) / 2, "z_max": (F.col("depth") + after) / 2, "top": after.isNull()})


def in_zone(z: Column, z_min: Column, z_max: Column, top: Column) -> Column:
    """z_min <= z < z_max, the last zone closed at its upper edge; NULL edges are open."""
    return F.coalesce(z >= z_min, F.lit(True)) & F.coalesce(F.when(top, z <= z_max).otherwise(z < z_max), F.lit(True))


def join_zones(points: DataFrame, zones: DataFrame, key: Sequence[str]) -> DataFrame:
    """The zone of each point.

    Zones (a few per key) are folded into one array row per key first, so the join is an
    equi-join that never multiplies points.
    """
    z = zones.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("zone_id", "z_min", "z_max", "top"))).alias("_zones"))
    hit = F.filter("_zones", lambda s: in_zone(F.col("z"), s["z_min"], s["z_max"], s["top"]))
    return points.join(z, list(key)).withColumn("zone_id", F.try_element_at(hit, F.lit(1))["zone_id"]).drop("_zones")


def nearest_instants(instants: DataFrame, minutes: Sequence[float], keys: Sequence[str] = DATASET) -> DataFrame:
    """Stored instants nearest to the requested minutes (earlier index on ties), each once."""
    wanted = F.explode(F.array(*[F.lit(float(m)) for m in minutes]))
    near = instants.withColumn("_m", wanted).groupBy(*keys, "_m").agg(
        F.min(F.struct(F.abs(F.col("t_min") - F.col("_m")).alias("d"), F.col("t_idx"), F.col("t_min"))).alias("_b"))
    return near.select(*keys, "_b.t_idx", "_b.t_min").distinct()


def first_temperature(field: DataFrame, keys: Sequence[str] = (*DATASET, "point_id"), value: str = "t_c") -> DataFrame:
    """Base value of every point or probe (its first instant); groups are one point's instants."""
    w = Window.partitionBy(*keys).orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    return field.withColumn("t_base", F.first(value).over(w))


def experimental_ceiling(samples: DataFrame, key: str = "corr_id") -> DataFrame:
    """A10: largest measured value over all zones of a correction."""
    return samples.groupBy(key).agg(F.max("y_exp").alias("exp_max"))


def corrected_cap(configured: Column | None, exp_max: Column) -> Column:
    """The smallest of the configured limit, 120 and the experimental ceiling."""
    parts = [F.lit(T_CORRECTED_MAX), exp_max] + ([configured] if configured is not None else [])
    return F.least(*parts)


def blended(factor: Column, offset: Column, intensity: Column | float) -> tuple[Column, Column]:
    """P25: factor moved towards 1 and offset towards 0 as the intensity falls to 0."""
    return 1 + intensity * (factor - 1), intensity * offset


def factor_table(zones: DataFrame, knots: DataFrame, instants: DataFrame, ssa: DataFrame | None = None) -> DataFrame:
    """Factor of every (correction, zone) at every absolute minute in ``instants`` (corr_id, t_min).

    Inside the knots the monotone cubic, after them the recurrence model if given, else the last
    knot; before them the correction is inactive. All inputs are per-correction tables: a zone's
    curve has the samples of its common axis, whatever the number of field points.
    """
    ends = knots.groupBy("corr_id", "zone_id").agg(
        F.min("t").alias("t_a"), F.max("t").alias("t_b"), F.max_by("f", "t").alias("f_b"), F.count(F.lit(1)).alias("n_k"))
    at = instants.join(zones.select("corr_id", "zone_id", "t_origin"), "corr_id").join(ends, ["corr_id", "zone_id"]) \
        .withColumn("t_rel", F.col("t_min") - F.col("t_origin"))
    at = at.withColumn("t_eval", F.least("t_rel", "t_b"))
    values = pchip(knots, at, ["corr_id", "zone_id"], at="t_eval", y="f", name="f_in", split=False)
    if ssa is not None:
        late = at.where(F.col("t_rel") > F.col("t_b") + 1e-9).select("corr_id", "zone_id", "t_min", "t_rel")
        values = values.join(forecast(ssa, late), ["corr_id", "zone_id", "t_min"], "left")
    else:
        values = values.withColumn("f_out", F.lit(None).cast("double"))
    inside = F.col("t_rel") <= F.col("t_b") + 1e-9
    f = F.when(inside, F.col("f_in")).otherwise(F.coalesce("f_out", "f_b"))
    active = (F.col("n_k") >= 2) & (F.col("t_rel") >= F.col("t_a") - 1e-9)
    return values.select("corr_id", "zone_id", "t_min", "t_rel", F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)).alias("factor"),
                         active.alias("active"))


def ssa_models(knots: DataFrame) -> DataFrame:
    """One recurrence model per (correction, zone); a group is one factor curve."""

    def fit(key, pdf):
        import pandas as pd
        m = numerics.ssa_model(pdf["t"].to_numpy(), pdf["f"].to_numpy())
        return pd.DataFrame([{"corr_id": key[0], "zone_id": key[1], **m}])

    return knots.groupBy("corr_id", "zone_id").applyInPandas(fit, SSA.replace("corr_id string", f"corr_id {knots.schema['corr_id'].dataType.simpleString()}"))


def forecast(models: DataFrame, at: DataFrame) -> DataFrame:
    """Model values at ``at`` (corr_id, zone_id, t_min, t_rel); a group is one zone's instants."""
    kind = models.schema["corr_id"].dataType.simpleString()

    def run(key, left, right):
        import pandas as pd
        if right.empty or left.empty:
            return pd.DataFrame({"corr_id": [], "zone_id": [], "t_min": [], "f_out": []})
        m = left.iloc[0].to_dict()
        return pd.DataFrame({"corr_id": key[0], "zone_id": key[1], "t_min": right["t_min"],
                             "f_out": numerics.ssa_forecast(m, right["t_rel"].to_numpy())})

    return models.groupBy("corr_id", "zone_id").cogroup(at.groupBy("corr_id", "zone_id")).applyInPandas(
        run, f"corr_id {kind}, zone_id int, t_min double, f_out double")


def zone_plan(zones: DataFrame, factors: DataFrame, intensity: float = 1.0, apply_offset: bool = True,
              cap_c: float | None = None) -> DataFrame:
    """One row per (correction, minute): zone bands with blended factor and offset, and the cap.

    Zone 0 is the global model; it is used only when a correction has no depth zones.
    """
    own = zones.groupBy("corr_id").agg(
        F.max(F.when(F.col("zone_id") > 0, True)).alias("zoned"), F.max(F.when(F.col("zone_id") == 0, F.col("offset_c"))).alias("off0"),
        F.max("exp_max").alias("exp_max"))
    z = zones.select("corr_id", "zone_id", "z_min", "z_max", "top", "offset_c").join(own, "corr_id").where(
        (F.col("zone_id") > 0) == F.coalesce("zoned", F.lit(False)))
    offset = F.coalesce("offset_c", "off0", F.lit(0.0)) if apply_offset else F.lit(0.0)
    f, off = blended(F.col("factor"), offset, intensity)
    cap = corrected_cap(None if cap_c is None else F.lit(float(cap_c)), F.col("exp_max"))
    band = F.struct("zone_id", "z_min", "z_max", "top", f.alias("f"), off.alias("off"), "active")
    return z.join(factors, ["corr_id", "zone_id"]).groupBy("corr_id", "t_min").agg(
        F.sort_array(F.collect_list(band)).alias("bands"), F.min(cap).alias("cap"), F.max("t_rel").alias("t_rel"))


def correct(field: DataFrame, plan: DataFrame, on: Sequence[str], value: str = "t_c", base: str = "t_base",
            name: str = "t_corr") -> DataFrame:
    """Base + offset + factor * (T - base) in the active band of each point, then the cap.

    ``plan`` has one row per key in ``on``, so the join keeps the number of points; the band is
    chosen inside the row. The plan is written once: it is then counted for the broadcast and
    read by the join without running the interpolation again.
    """
    plan = broadcast_if_small(cut(plan), PLAN_BROADCAST_ROWS)
    hit = F.try_element_at(F.filter("bands", lambda s: in_zone(F.col("z"), s["z_min"], s["z_max"], s["top"])), F.lit(1))
    j = field.join(plan, list(on)).withColumn("_s", hit)
    moved = F.col(base) + F.col("_s.off") + F.col("_s.f") * (F.col(value) - F.col(base))
    t = F.when(F.coalesce("_s.active", F.lit(False)), moved).otherwise(F.col(value))
    return j.withColumn(name, F.when(t > F.col("cap"), F.col("cap")).otherwise(t)).drop("_s", "bands")


def sustained_cutoff(instants: DataFrame, flag: Column, keys: Sequence[str] = DATASET, t: str = "t_min") -> DataFrame:
    """First time from which the flag holds to the end; NULL when it does not.

    Two aggregates (last time without the flag, first time after it) instead of a suffix window.
    """
    f = instants.withColumn("_f", F.coalesce(flag, F.lit(False)))
    last = f.groupBy(*keys).agg(F.max(F.when(~F.col("_f"), F.col(t))).alias("_last"))
    return f.join(last, list(keys)).groupBy(*keys).agg(
        F.min(F.when(F.col("_last").isNull() | (F.col(t) > F.col("_last")), F.col(t))).alias("cutoff"))


def sustained_carbon(instants: DataFrame, limit: Column, keys: Sequence[str] = DATASET, at: float = 1.0, within: float = 0.51) -> DataFrame:
    """Every maximum from the instant nearest to minute 1 on exceeds the limit.

    ``instants`` holds (keys, t_idx, t_min, t_max_c).
    """
    near = instants.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("t_min") - at).alias("d"), F.col("t_idx"), F.col("t_min").alias("t1"))).alias("_n"))
    j = instants.join(near, list(keys)).where(F.col("t_min") >= F.col("_n.t1") - 1e-9)
    return j.groupBy(*keys).agg(
        (F.bool_and(F.coalesce(F.col("t_max_c") > limit, F.lit(False))) & (F.min("_n.d") <= within)).alias("carbon"))


def time_plan(instants: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """Position by ascending time, untimed last, with the three maxima (data, metadata, decision)."""
    w = Window.partitionBy(*keys).orderBy(F.col("t_min").asc_nulls_last(), F.col("t_idx"))
    return instants.withColumns({"pos": F.row_number().over(w), "t_max_decision": F.greatest("t_max_c", "t_max_meta")})


def tmax_consistency(instants: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """Pairs of maxima that differ by more than 1e-6, and the largest difference."""
    d = F.abs(F.col("t_max_c") - F.col("t_max_meta"))
    return instants.groupBy(*keys).agg(
        F.count(d).alias("n_pairs"), F.count_if(d > 1e-6).alias("n_diff"), F.max(d).alias("max_diff"))


def within_horizon(field: DataFrame, horizon: float, keys: Sequence[str] = DATASET, value: str = "t_c") -> DataFrame:
    """instants up to the horizon, or all of them when none of those has a value."""
    hit = field.groupBy(*keys).agg(F.max(F.when(F.col(value).isNotNull(), F.col("t_min") <= horizon + 1e-9)).alias("_any"))
    return field.join(hit, list(keys)).where(~F.coalesce("_any", F.lit(False)) | (F.col("t_min") <= horizon + 1e-9)).drop("_any")


def even_sample(df: DataFrame, keys: Sequence[str], order: str, n_max: int, ties: Sequence[str] = ()) -> DataFrame:
    """O3: ``n_max`` evenly spaced rows of each key (all rows when there are fewer).

    The rank comes from the range-wise ``ranked``, so a hot key is not sorted in one task.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    r = ranked(df, keys, order, ties, "_rn").join(n, list(keys))
    step = (F.col("_total") - 1) / F.lit(max(1, n_max - 1))
    k = F.ceil((F.col("_rn") - 1.5) / step)
    hit = (k >= 0) & (k <= n_max - 1) & (k * step < F.col("_rn") - 0.5)
    return r.where((F.col("_total") <= n_max) | hit).drop("_rn", "_total")


def stride_sample(df: DataFrame, keys: Sequence[str], order: str, target: int = 12_000, ties: Sequence[str] = ()) -> DataFrame:
    """Every k-th row of each key, k = floor(n / target), at least 1."""
    n = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / target)).alias("_step"))
    r = ranked(df, keys, order, ties, "_rn").join(n, list(keys))
    return r.where((F.col("_rn") - 1) % F.col("_step") == 0).drop("_rn", "_step")


def top_nearest(df: DataFrame, keys: Sequence[str], distance: Column, k: int = 250, ties: Sequence[str] = ()) -> DataFrame:
    """The k smallest distances per key; each task keeps k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(distance, *ties)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


# Outcomes of an instant.
CUT, NO_POINTS, REGIONS, EXPORT = CLOUD_STATES = ("corte", "sin_puntos", "varias_regiones", "exportar")
# Voxel numbers count from here, so that places below zero have one too; the middle of a block of 32, so that a small cloud around zero lies in one.
VOXEL_ORIGIN = (1 << 20) + 16


def cloud_regions(field: DataFrame, low: Column, high: Column, spacing: Sequence[float], keys: Sequence[str] = DATASET) -> DataFrame:
    """C15 for the clouds of all instants at once: (keys, t_idx, n_regions, single).

    The cloud is what the temperature window keeps (instants with fewer than four points have none), in voxels of ``spacing`` per axis;
    regions touch by a face, an edge or a corner. Clouds are labelled block by block and joined in one contraction for all of them.
    """
    from .voxel import VOXEL, region_counts
    cloud = [*keys, "t_idx"]
    kept = temperature_window(field, low, high, cloud)
    at = [(F.floor(F.col(a) / step) + VOXEL_ORIGIN).cast("int").alias(i) for a, i, step in zip("xyz", VOXEL, spacing)]
    return region_counts(kept.select(*cloud, *at).distinct(), cloud)


def cloud_status(field: DataFrame, low: Column, high: Column, keys: Sequence[str] = DATASET, regions: DataFrame | None = None,
                 spacing: Sequence[float] | None = None) -> DataFrame:
    """C14: one row per instant with its outcome: ``corte``, ``sin_puntos``, ``varias_regiones`` or ``exportar``.

    Instants at or after the sustained cutoff are cut. With ``spacing`` the clouds' regions are counted (:func:`cloud_regions`);
    ``regions`` (keys, t_idx, n_regions) is the result of a check run before.
    """
    if regions is None and spacing is not None:
        regions = cloud_regions(field, low, high, spacing, keys).drop("single")
    t = F.col("t_c")
    inst = field.groupBy(*keys, "t_idx", "t_min").agg(
        F.max(t).alias("t_max_c"), F.count_if(t.between(low, high)).alias("n_points"), F.max(high).alias("_high"))
    cut = sustained_cutoff(inst, F.col("t_max_c") > F.col("_high"), keys)
    j = inst.join(cut, list(keys))
    many = F.lit(False)
    if regions is not None:
        j = j.join(regions, [*keys, "t_idx"], "left")
        many = F.coalesce(F.col("n_regions") != 1, F.lit(False))
    status = F.when(F.col("t_min") >= F.col("cutoff"), CUT).when(F.col("n_points") < 4, NO_POINTS).when(many, REGIONS).otherwise(EXPORT)
    return j.withColumn("status", status).drop("_high")


def cloud_outcomes(status: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """C14: number of instants of each outcome per dataset, one column an outcome."""
    return status.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in CLOUD_STATES])


def rebuilt_snapshots(corrected: DataFrame, threshold: Column | float = T_ABL_VOLUME, keys: Sequence[str] = (*DATASET, "corr_id", "t_idx"),
                      value: str = "t_corr") -> tuple[DataFrame, DataFrame]:
    """Filtered clouds and per-instant statistics of a corrected field."""
    lit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    points = corrected.where(F.col(value) >= lit)
    stats = corrected.groupBy(*keys).agg(
        F.min(value).alias("t_min_c"), F.max(value).alias("t_max_c"), F.count(value).alias("n_total"),
        F.count_if(F.col(value) >= lit).alias("n_filtered"), F.max("t_rel").alias("t_rel"))
    return points, stats
