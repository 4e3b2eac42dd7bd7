"""Probe and experiment curves: cleaning, resampling, factor, fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numerics
from ..functions.nulls import finite
from ..session import cut
from .skew import ROWS_PER_RANGE, carried, drop_halo, halo_window, is_hot, with_halo


def clean_curve(df: DataFrame, keys: Sequence[str], t: str = "t_min", y: str = "t_c", seq: str | None = None) -> DataFrame:
    """Finite samples, one per time (the first by ``seq``).

    The per-time choice is a ``min_by`` aggregate, combined before the shuffle.
    """
    ok = df.where(finite(t).isNotNull() & finite(y).isNotNull())
    pick = F.min_by(y, F.col(seq) if seq else F.col(y))
    return ok.groupBy(*keys, t).agg(pick.alias(y))


def valid_series(clean: DataFrame, keys: Sequence[str], t: str = "t_min") -> DataFrame:
    """Keys with at least two samples over a positive interval, and their bounds."""
    return clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(t).alias("t_first"), F.max(t).alias("t_last")
    ).where((F.col("n") >= 2) & (F.col("t_last") > F.col("t_first")))


def trim_window(df: DataFrame, keys: Sequence[str], t: str = "t_min", start: str | float | None = None,
                stop: str | float | None = None) -> DataFrame:
    """F16: rows between two times, each a number or a per-series column of ``df``.

    A missing bound is the series' own first or last time; an upper bound that does not exceed the
    lower one becomes the last time. Series left with fewer than two samples are listed by
    ``too_short``.
    """
    given = lambda b: F.max(b) if isinstance(b, str) else F.lit(b).cast("double")
    bounds = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"), given(start).alias("_a"), given(stop).alias("_b"))
    low, high = F.coalesce("_a", "_lo"), F.coalesce("_b", "_hi")
    bounds = bounds.select(*keys, low.alias("_t0"), F.when(high > low, high).otherwise(F.col("_hi")).alias("_t1"))
    return df.join(bounds, list(keys)).where(F.col(t).between(F.col("_t0"), F.col("_t1"))).drop("_t0", "_t1")


def too_short(df: DataFrame, trimmed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F16: series that keep fewer than two samples after the trim."""
    left = trimmed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return df.select(*keys).distinct().join(left, list(keys), "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n")).where("n < 2")


def zero_based(df: DataFrame, keys: Sequence[str], t: str = "t_min", name: str = "t_rel") -> DataFrame:
    """Time since the series' first kept sample."""
    first = df.groupBy(*keys).agg(F.min(t).alias("t_origin"))
    return df.join(first, list(keys)).withColumn(name, F.col(t) - F.col("t_origin"))


def pchip_slopes(knots: DataFrame, keys: Sequence[str], t: str = "t", y: str = "y", rows: int = ROWS_PER_RANGE,
                 split: bool | None = None) -> DataFrame:
    """Knots with the shape-preserving cubic that starts at each of them, as a ``seg`` struct.

    Interior slopes are the weighted harmonic mean of the neighbouring secants (zero at a local
    extremum); end slopes are the limited three-point estimate; two knots give a line. The last
    knot repeats the last piece, so a look-up beyond the ends continues the end cubics.
    """
    w = halo_window(keys)
    k = with_halo(knots.select(*keys, F.col(t).alias("t"), F.col(y).alias("y")), keys, "t", 3, rows, split)
    lead, lag = (lambda c: F.lead(c).over(w)), (lambda c: F.lag(c).over(w))
    k = k.withColumns({"h": lead("t") - F.col("t"), "dy": (lead("y") - F.col("y"))})
    k = k.withColumn("d", F.col("dy") / F.col("h"))
    k = k.withColumns({"h_": lag("h"), "d_": lag("d"), "hn": lead("h"), "dn": lead("d"),
                       "h__": F.lag("h", 2).over(w), "d__": F.lag("d", 2).over(w)})
    h, d, h_, d_, hn, dn, h__, d__ = (F.col(c) for c in ("h", "d", "h_", "d_", "hn", "dn", "h__", "d__"))
    w1, w2 = 2 * h + h_, h + 2 * h_
    inner = F.when(d_ * d > 0, (w1 + w2) / (w1 / d_ + w2 / d)).otherwise(F.lit(0.0))

    def end(h0, d0, h1, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        s = F.when(F.signum(s) != F.signum(d0), F.lit(0.0)).when(
            (F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)
        return F.when(d1.isNull(), d0).otherwise(s)

    slope = F.when(d_.isNull(), end(h, d, hn, dn)).when(d.isNull(), end(h_, d_, h__, d__)).otherwise(inner)
    k = k.withColumn("s", slope)
    k = k.withColumns({"s1": lead("s"), "y1": lead("y")})
    piece = F.struct(F.col("t").alias("t0"), F.col("y").alias("y0"), F.col("s").alias("s0"),
                     F.col("h").alias("h"), F.col("y1").alias("y1"), F.col("s1").alias("s1"))
    k = k.withColumn("seg", F.when(h.isNotNull(), piece))
    k = k.withColumn("seg", F.coalesce("seg", F.lag("seg").over(w)))
    return drop_halo(k).select(*keys, "t", "y", "seg")


def hermite(seg: Column, t: Column) -> Column:
    """Value at ``t`` of the cubic piece ``seg``."""
    u = (t - seg["t0"]) / seg["h"]
    v = 1 - u
    return (seg["y0"] * v * v * (1 + 2 * u) + seg["y1"] * u * u * (3 - 2 * u)
            + seg["h"] * (seg["s0"] * u * v * v - seg["s1"] * u * u * v))


def pchip(knots: DataFrame, targets: DataFrame, keys: Sequence[str], at: str = "t", t: str = "t", y: str = "y",
          name: str = "y_interp", rows: int = ROWS_PER_RANGE, split: bool | None = None) -> DataFrame:
    """Evaluate the monotone cubic through ``knots`` at the times of ``targets`` (same keys).

    Knots and targets are merged in time order and each target takes the last piece before it,
    so the join costs one sort by (key, time) and never pairs a target with all knots.
    """
    keys = list(keys)
    if split is None:
        split = is_hot(knots, keys, rows) or is_hot(targets, keys, rows)
    seg = pchip_slopes(knots, keys, t, y, rows, split)
    left = seg.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_kind"), "seg")
    right = targets.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_kind"),
                           F.struct(*targets.columns).alias("_row"))
    merged = left.unionByName(right, allowMissingColumns=True)
    merged = carried(merged, keys, "_t", ["_kind"], {"_seg": "seg"}, rows, split)
    out = merged.where("_kind = 1").select("_row.*", hermite(F.col("_seg"), F.col("_t")).alias(name))
    return out


def common_grid(pairs: DataFrame, keys: Sequence[str], horizon: str, n: int) -> DataFrame:
    """Even sample points 0..horizon, ``max(20, n)`` per key."""
    n = max(20, int(round(n)))
    return pairs.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col(horizon).alias("_h")) \
        .select(*keys, "i", (F.col("_h") * F.col("i") / (n - 1)).alias("t"))


def synchronise(exp: DataFrame, sim: DataFrame, keys: Sequence[str], n: int = 1000, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Both curves on one even time axis up to the shorter horizon.

    ``exp`` and ``sim`` hold cleaned rows (keys, t, y) whose time starts at the trim.
    """
    keys = list(keys)
    end = lambda df: df.groupBy(*keys).agg(F.max("t").alias("hi"), F.min("t").alias("lo"), F.count(F.lit(1)).alias("n")) \
        .where((F.col("n") >= 2) & (F.col("hi") > F.col("lo")))
    horizon = end(exp).select(*keys, F.col("hi").alias("_e")).join(
        end(sim).select(*keys, F.col("hi").alias("_s")), keys)
    horizon = horizon.select(*keys, F.least("_e", "_s").alias("horizon")).where("horizon > 0")
    grid = common_grid(horizon, keys, "horizon", n)
    both = exp.withColumn("side", F.lit("e")).unionByName(sim.withColumn("side", F.lit("s")))
    wanted = grid.withColumn("side", F.explode(F.array(F.lit("e"), F.lit("s"))))
    split = n > rows or is_hot(both, [*keys, "side"], rows)
    values = pchip(both, wanted, [*keys, "side"], rows=rows, split=split)
    return values.groupBy(*keys, "i", "t").agg(
        F.max(F.when(F.col("side") == "e", F.col("y_interp"))).alias("y_exp"),
        F.max(F.when(F.col("side") == "s", F.col("y_interp"))).alias("y_sim"))


def factor_curve(sync: DataFrame, keys: Sequence[str], rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Cooling factor on the common axis.

    A sample is stable when the simulated increment reaches max(0.5, 1 % of its largest
    magnitude). Stable ratios, clipped to 0..1, are joined by the monotone cubic; earlier
    samples take the first stable value. A key has exactly the samples of its common axis, so
    per-key windows are bounded by that number; the increments are written once because they are
    both the knots and the targets of the interpolation.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    inc = sync.withColumns({"base_exp": F.first("y_exp").over(w.orderBy("i")), "base_sim": F.first("y_sim").over(w.orderBy("i"))})
    inc = inc.withColumns({"inc_exp": F.col("y_exp") - F.col("base_exp"), "inc_sim": F.col("y_sim") - F.col("base_sim")})
    inc = inc.withColumn("threshold", F.greatest(F.lit(0.5), 0.01 * F.max(F.abs("inc_sim")).over(w)))
    inc = inc.withColumn("stable", F.col("inc_sim") >= F.col("threshold"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("inc_exp") / F.col("inc_sim")))
    inc = inc.withColumn("ratio", F.when(F.col("stable"), ratio))
    first = F.min(F.when(F.col("stable"), F.struct("t", "ratio"))).over(w)
    inc = inc.withColumns({"t_stable": first["t"], "f_stable": first["ratio"], "n_stable": F.count("ratio").over(w)})
    inc = cut(inc.where("n_stable > 0"))
    stable = inc.where("stable").select(*keys, "t", F.col("ratio").alias("y"))
    out = pchip(stable, inc, keys, name="f_raw", rows=rows, split=False)
    level = F.when((F.col("t") <= F.col("t_stable")) | (F.col("n_stable") == 1), F.col("f_stable")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f_raw"))))
    out = out.withColumns({"factor": level, "offset_c": F.col("base_exp") - F.col("base_sim")})
    corrected = F.col("base_sim") + F.col("offset_c") + F.col("factor") * F.col("inc_sim")
    return out.withColumn("sim_corr", corrected).select(
        *keys, "i", "t", "y_exp", "y_sim", "base_exp", "base_sim", "offset_c", "inc_exp", "inc_sim",
        "threshold", "stable", "factor", "sim_corr")


def rmse(a: Column, b: Column) -> Column:
    """Root of the mean squared difference; missing pairs are left out."""
    d = a - b
    return F.sqrt(F.avg(d * d))


def polynomial_fit(sync: DataFrame, keys: Sequence[str], degree: int = 6, t: str = "t", y: str = "y") -> DataFrame:
    """Least-squares polynomial of y(t), degree min(cfg, 12, n - 1), highest power first.

    The normal equations are a handful of power sums per key in time scaled to -1..1 on the
    Chebyshev basis, so the shuffle carries one partial row per key and task and the solve
    handles one small matrix per key.
    """
    keys = list(keys)
    cap = min(degree, 12)
    span = sync.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.count(F.lit(1)).alias("_n"))
    s = sync.join(span, keys).withColumn(
        "_u", F.when(F.col("_b") > F.col("_a"), 2 * (F.col(t) - F.col("_a")) / (F.col("_b") - F.col("_a")) - 1).otherwise(F.lit(0.0)))
    basis = [F.lit(1.0), F.col("_u")]
    while len(basis) <= 2 * cap:
        basis.append(None)
    # T_j T_k = (T_{j+k} + T_{|j-k|}) / 2, so the sums of T_0..T_2d and y T_0..T_d are enough.
    cheb = lambda m: F.cos(F.lit(float(m)) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_u")))))
    sums = [F.sum(cheb(m)).alias(f"_s{m}") for m in range(2 * cap + 1)]
    sums += [F.sum(F.col(y) * cheb(m)).alias(f"_r{m}") for m in range(cap + 1)]
    table = s.groupBy(*keys, "_a", "_b", "_n").agg(*sums)
    solve = F.pandas_udf(numerics.chebyshev_solver(cap), "array<double>")
    return table.select(*keys, F.least(F.lit(cap), (F.col("_n") - 1).cast("int")).alias("degree"), solve(
        F.array(*[F.col(f"_s{m}") for m in range(2 * cap + 1)]), F.array(*[F.col(f"_r{m}") for m in range(cap + 1)]),
        F.col("_a"), F.col("_b"), F.col("_n")).alias("poly"))


def polyval(poly: Column, t: Column) -> Column:
    """Horner evaluation, highest power first."""
    return F.aggregate(poly, F.lit(0.0), lambda acc, c: acc * t + c)


def adjustment(corrected: Column, simulated: Column, poly: Column, t: Column) -> Column:
    """Corrected minus simulated, else minus the fitted polynomial."""
    return F.coalesce(corrected - simulated, -polyval(poly, t))


def pair_probes(sim: DataFrame, exp: DataFrame, run: str, wanted: str | None = None) -> DataFrame:
    """Each simulated probe with the experimental one of the same position.

    ``sim`` and ``exp`` hold (run, probe_idx, label). Positions beyond the last experimental
    probe take that last one; ``wanted`` restricts to the simulated probe with that label, or
    the first probe when no label matches.
    """
    s = sim
    if wanted is not None:
        hit = sim.groupBy(run).agg(F.coalesce(
            F.min(F.when(F.col("label") == wanted, F.col("probe_idx"))), F.min("probe_idx")).alias("probe_idx"))
        s = sim.join(hit, [run, "probe_idx"])
    last = exp.groupBy(run).agg(F.max("probe_idx").alias("_n"))
    s = s.join(last, run).withColumn("exp_idx", F.greatest(F.lit(1), F.least("probe_idx", "_n"))).drop("_n")
    return s.join(exp.select(run, F.col("probe_idx").alias("exp_idx"), F.col("label").alias("exp_label")), [run, "exp_idx"])


def horizon_minutes(zones: DataFrame, key: str = "corr_id") -> DataFrame:
    """Last covered absolute minute of a correction, over all of its zones."""
    return zones.groupBy(key).agg(F.max(F.col("t_origin") + F.col("t_last")).alias("horizon_min"))


def upgrade_legacy(df: DataFrame) -> DataFrame:
    """Curves of old corrections from base plus increment, factor from the curves where absent."""
    y_exp = F.coalesce(F.col("y_exp"), F.col("base_exp") + F.col("inc_exp"))
    y_sim = F.coalesce(F.col("y_sim"), F.col("base_sim") + F.col("inc_sim"))
    return df.withColumns({"y_exp": y_exp, "y_sim": y_sim})


def zone_curve(samples: DataFrame, zone: int, key: str = "corr_id") -> DataFrame:
    """Samples of one zone, each missing value taken from the global curve (zone 0)."""
    values = ("y_exp", "y_sim", "factor")
    z = samples.where(F.col("zone_id") == zone).select(key, "t", *values)
    g = samples.where("zone_id = 0").select(key, "t", *[F.col(v).alias(f"g_{v}") for v in values])
    return g.join(z, [key, "t"], "left").select(
        key, "t", F.lit(zone).alias("zone_id"), *[F.coalesce(v, f"g_{v}").alias(v) for v in values])


def zone_label(zone: Column, z_min: Column, z_max: Column) -> Column:
    """Label with the depth range."""
    edge = lambda c: F.when(c.isNull(), "inf").otherwise(F.format_string("%.1f", c))
    return F.concat(F.lit("Zona "), zone.cast("string"), F.lit(" ["), edge(z_min), F.lit(", "), edge(z_max), F.lit("] mm"))
