"""Calibration: simulated and measured probe curves to a correction (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import field as FL


def paired_zones(sim: DataFrame, exp: DataFrame, run: str = "corr_id") -> DataFrame:
    """Zone table of each run: zone 0 is the first simulated probe; zones 1..n pair by position.

    n is the smaller of the probe counts, and at least two. Depths come from the column ``depth`` of
    ``sim``; without it only as many zones as there are default depths can be placed.
    """
    count = lambda df, name: df.groupBy(run).agg(F.max("probe_idx").alias(name))
    n = count(sim, "_s").join(count(exp, "_e"), run)
    most = [] if "depth" in sim.columns else [F.lit(len(FL.ZONE_DEPTHS_SIM))]
    n = n.select(run, F.least(F.col("_s"), F.col("_e"), *most).cast("int").alias("_n"))
    n = n.select(run, F.explode(F.when(F.col("_n") >= 2, F.sequence(F.lit(0), F.col("_n"))).otherwise(F.array(F.lit(0)))).alias("zone_id"))
    return n.withColumn("probe_idx", F.greatest(F.lit(1), F.col("zone_id")))


def calibrate(sim: DataFrame, exp: DataFrame, n_common: int = 1000, degree: int = 6, rows: int = 1_000_000) -> dict[str, DataFrame]:
    """C4: zones, knots, samples and fits of every run in one job.

    ``sim`` and ``exp`` hold (corr_id, probe_idx, t_min, t_c) and, where a time may repeat, ``seq``: its first sample counts.
    ``sim`` may hold the ``depth`` of each probe. Returns ``zones`` (with edges,
    offset, origin and ceiling), ``knots`` (the factor curve), ``samples`` (all curves), ``fits``
    (polynomial and both RMSEs) and ``ssa`` (forecast models).
    """
    keys = ["corr_id", "zone_id"]
    table = paired_zones(sim, exp)

    def side(df: DataFrame) -> DataFrame:
        order = ["seq"] if "seq" in df.columns else []
        rows_ = table.join(df.select("corr_id", "probe_idx", "t_min", "t_c", *order), ["corr_id", "probe_idx"])
        clean = C.clean_curve(rows_, keys, seq=order[0] if order else None)
        return C.zero_based(clean, keys).select(*keys, F.col("t_rel").alias("t"), F.col("t_c").alias("y"), "t_origin")

    s, e = side(sim), side(exp)
    sync = C.synchronise(e.drop("t_origin"), s.drop("t_origin"), keys, n_common, rows)
    samples = C.factor_curve(sync, keys, rows)
    delta = samples.withColumn("delta", F.col("y_sim") - F.col("y_exp"))
    fits = C.polynomial_fit(delta, keys, degree, y="delta")
    quality = delta.join(fits, keys).groupBy(*keys).agg(
        C.rmse(C.polyval(F.col("poly"), F.col("t")), F.col("delta")).alias("rmse_poly"), C.rmse(F.col("sim_corr"), F.col("y_exp")).alias("rmse_factor"))
    knots = samples.select(*keys, "t", F.col("factor").alias("f"))
    origin = s.groupBy(*keys).agg(F.max("t_origin").alias("t_origin"))
    ends = samples.groupBy(*keys).agg(F.max("offset_c").alias("offset_c"), F.max("y_exp").alias("_y"), F.max("t").alias("t_last"))
    top = ends.groupBy("corr_id").agg(F.max("_y").alias("exp_max"))
    placed = table.where("zone_id > 0")
    if "depth" in sim.columns:
        depths = placed.join(sim.groupBy("corr_id", "probe_idx").agg(F.min("depth").alias("depth")), ["corr_id", "probe_idx"])
    else:
        depths = placed.withColumn("depth", F.element_at(F.array(*[F.lit(d) for d in FL.ZONE_DEPTHS_SIM]), F.col("zone_id")))
    edges = FL.zone_edges(depths.select(*keys, "depth"), ["corr_id"])
    zones = ends.drop("_y").join(origin, keys).join(top, "corr_id").join(edges, keys, "left").withColumn("top", F.coalesce("top", F.lit(True)))
    return {"zones": zones, "knots": knots, "samples": samples, "fits": fits.join(quality, keys), "ssa": FL.ssa_models(knots)}
