"""Curves: cleaning, trimming, resampling, factor, fits, forecasts and the whole calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.functions import numerics
from thermal_lake.operators import curves as C
from thermal_lake.operators import field as FL
from thermal_lake.plans import calibrate as CAL

from . import standins as S
from .core import R, query, rnd, sub, table, view

CURVE = sub(S.CURVE)
KEYS = ["corr_id", "probe_idx"]
N = 40


def pchip_sql(knots: str, targets: str, keys: list[str], out: str = "y_interp") -> str:
    """Monotone cubic in SQL: ``knots`` (keys, t, y) evaluated for ``targets`` (keys, t, ...)."""
    k = ", ".join(keys)
    on = " AND ".join(f"g.{c} = s.{c}" for c in keys)
    w = f"OVER (PARTITION BY {k} ORDER BY t)"
    end = lambda h0, d0, h1, d1: (
        f"CASE WHEN {d1} IS NULL THEN {d0} WHEN sign((({'2*' + h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1})) <> sign({d0}) THEN 0.0 "
        f"WHEN sign({d0}) <> sign({d1}) AND abs((({'2*' + h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1})) > 3*abs({d0}) THEN 3*{d0} ELSE ((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1}) END")
    return f"""(WITH k0 AS (SELECT {k}, t, y, lead(t) {w} - t AS h, (lead(y) {w} - y) / (lead(t) {w} - t) AS d FROM ({knots}) kn),
 k1 AS (SELECT *, lag(h) {w} AS hp, lag(d) {w} AS dp, lead(h) {w} AS hn, lead(d) {w} AS dn, lag(h, 2) {w} AS hq, lag(d, 2) {w} AS dq FROM k0),
 k2 AS (SELECT *, CASE WHEN dp IS NULL THEN {end('h', 'd', 'hn', 'dn')} WHEN d IS NULL THEN {end('hp', 'dp', 'hq', 'dq')}
   WHEN dp * d > 0 THEN (3*h + 3*hp) / ((2*h + hp) / dp + (h + 2*hp) / d) ELSE 0.0 END AS s FROM k1),
 k3 AS (SELECT *, lead(y) {w} AS y1, lead(s) {w} AS s1, lag(t) {w} AS tp, lead(h) {w} AS hz, lead(t) {w} AS tn FROM k2),
 k4 AS (SELECT *, CASE WHEN tp IS NULL THEN -1e300 ELSE t END AS lo, CASE WHEN hz IS NULL THEN 1e300 ELSE tn END AS hi, t AS t0 FROM k3 WHERE h IS NOT NULL)
SELECT g.*, s.y * (1-u) * (1-u) * (1+2*u) + y1 * u * u * (3-2*u) + h * (s * u * (1-u) * (1-u) - s1 * u * u * (1-u)) AS {out}
FROM (SELECT g.*, s.y, s.y1, s.h, s.s, s.s1, (g.t - s.t0) / s.h AS u FROM ({targets}) g JOIN k4 s ON {on} AND g.t >= s.lo AND g.t < s.hi) s JOIN ({targets}) g ON {on} AND g.t = s.t)""".replace(
        "SELECT g.*, s.y * (1-u)", f"SELECT {', '.join('s.' + c for c in keys)}, s.t, s.y * (1-u)").replace(
        f") s JOIN ({targets}) g ON {on} AND g.t = s.t)", ") s)")


# Cleaned, zero-based curves of both sides.
def _clean(side: int) -> str:
    return f"""SELECT corr_id, probe_idx, t_min - min(t_min) OVER (PARTITION BY corr_id, probe_idx) AS t, t_c AS y FROM (SELECT *, row_number() OVER (PARTITION BY corr_id, probe_idx, t_min ORDER BY seq) AS rn FROM ({CURVE}) c WHERE side = {side}) q WHERE rn = 1"""


_HOR = f"""(SELECT corr_id, probe_idx, least(e.hi, s.hi) AS hor FROM (SELECT corr_id, probe_idx, max(t) AS hi, count(*) AS n FROM ({_clean(1)}) a GROUP BY 1, 2) e JOIN (SELECT corr_id, probe_idx, max(t) AS hi, count(*) AS n FROM ({_clean(0)}) a GROUP BY 1, 2) s USING (corr_id, probe_idx) WHERE e.n >= 2 AND s.n >= 2 AND e.hi > 0 AND s.hi > 0)"""
_TGT = f"SELECT corr_id, probe_idx, CAST(i AS INT) AS i, hor * i / {N - 1} AS t FROM {_HOR} h, range({N}) r(i)"


def curves(spark, d):
    """(exp, sim): cleaned zero-based curves with columns corr_id, probe_idx, t, y."""
    c = view(spark, d, S.CURVE)
    out = []
    for side in (1, 0):
        clean = C.clean_curve(c.where(F.col("side") == side), KEYS, seq="seq")
        out.append(C.zero_based(clean, KEYS).select(*KEYS, F.col("t_rel").alias("t"), F.col("t_c").alias("y")))
    return out


@query("F16_time_window_trim", f"""WITH c AS ({CURVE}), b AS (SELECT corr_id, probe_idx, min(t_min) AS lo, max(t_min) AS hi FROM c GROUP BY 1, 2), w AS (SELECT corr_id, probe_idx, CASE WHEN corr_id % 3 = 0 THEN lo ELSE 10000 END AS t0, CASE WHEN corr_id % 5 = 0 OR 30000 <= CASE WHEN corr_id % 3 = 0 THEN lo ELSE 10000 END THEN hi ELSE 30000 END AS t1 FROM b)
SELECT c.corr_id, c.probe_idx, count(*) AS n, min(t_min) AS t0, max(t_min) AS t1 FROM c JOIN w USING (corr_id, probe_idx) WHERE t_min BETWEEN w.t0 AND w.t1 GROUP BY 1, 2""")
def time_window_trim(spark, d):
    c = view(spark, d, S.CURVE).withColumns({"a": F.when(F.col("corr_id") % 3 != 0, F.lit(10000.0)), "b": F.when(F.col("corr_id") % 5 != 0, F.lit(30000.0))})
    t = C.trim_window(c, KEYS, start="a", stop="b")
    return t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("t_min").alias("t0"), F.max("t_min").alias("t1"))


@query("P17_relative_time", f"SELECT corr_id, probe_idx, side, seq, {R('t_min - min(t_min) OVER (PARTITION BY corr_id, probe_idx, side)')} AS t_rel FROM ({CURVE}) c")
def relative_time(spark, d):
    return C.zero_based(view(spark, d, S.CURVE), [*KEYS, "side"]).select(*KEYS, "side", "seq", rnd("t_rel").alias("t_rel"))


@query("J4_probe_pairing", f"""WITH c AS ({CURVE}), s AS (SELECT corr_id, max(probe_idx) AS n FROM c WHERE side = 0 GROUP BY 1), e AS (SELECT corr_id, greatest(1, max(probe_idx) - corr_id % 2) AS n FROM c WHERE side = 1 GROUP BY 1)
SELECT s.corr_id, CAST(i AS INT) AS probe_idx, 'S' || CAST(i AS VARCHAR) AS label, CAST(least(i, e.n) AS INT) AS exp_idx, 'P' || CAST(CAST(least(i, e.n) AS INT) AS VARCHAR) AS exp_label FROM s JOIN e USING (corr_id), range(1, 5) r(i) WHERE i <= s.n""")
def probe_pairing(spark, d):
    c = view(spark, d, S.CURVE)
    top = lambda side: c.where(F.col("side") == side).groupBy("corr_id").agg(F.max("probe_idx").alias("n"))
    rows = lambda t, n, p: t.select("corr_id", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("probe_idx")).withColumn("label", F.concat(F.lit(p), F.col("probe_idx").cast("string")))
    sim = rows(top(0), F.col("n"), "S")
    exp = rows(top(1), F.greatest(F.lit(1), F.col("n") - F.col("corr_id") % 2), "P")
    return C.pair_probes(sim, exp, "corr_id").select("corr_id", "probe_idx", "label", "exp_idx", "exp_label")


_SYNC = f"""(SELECT g.corr_id, g.probe_idx, g.i, g.t, e.y_interp AS y_exp, s.y_interp AS y_sim FROM ({_TGT}) g JOIN {pchip_sql(_clean(1), _TGT, KEYS)} e USING (corr_id, probe_idx, t) JOIN {pchip_sql(_clean(0), _TGT, KEYS)} s USING (corr_id, probe_idx, t))"""


@query("W7_monotone_cubic_resampling", f"SELECT corr_id, probe_idx, i, {R('t')} AS t, {R('y_exp')} AS y_exp, {R('y_sim')} AS y_sim FROM {_SYNC} t")
def monotone_cubic(spark, d):
    e, s = curves(spark, d)
    return C.synchronise(e, s, KEYS, N).select(*KEYS, "i", rnd("t").alias("t"), rnd("y_exp").alias("y_exp"), rnd("y_sim").alias("y_sim"))


@query("W7_skew_safe_blocks", f"SELECT corr_id, probe_idx, i, {R('t')} AS t, {R('y_exp')} AS y_exp, {R('y_sim')} AS y_sim FROM {_SYNC} t")
def monotone_cubic_blocks(spark, d):
    """The same curves with series cut into blocks of a few rows, as a hot series would be."""
    e, s = curves(spark, d)
    return C.synchronise(e, s, KEYS, N, rows=7).select(*KEYS, "i", rnd("t").alias("t"), rnd("y_exp").alias("y_exp"), rnd("y_sim").alias("y_sim"))


_INC = f"""(SELECT *, y_exp - base_exp AS inc_exp, y_sim - base_sim AS inc_sim, greatest(0.5, 0.01 * max(abs(y_sim - base_sim)) OVER (PARTITION BY corr_id, probe_idx)) AS threshold
 FROM (SELECT *, first_value(y_exp) OVER (PARTITION BY corr_id, probe_idx ORDER BY i) AS base_exp, first_value(y_sim) OVER (PARTITION BY corr_id, probe_idx ORDER BY i) AS base_sim FROM sync) b)"""


def _factor(prefix: str = "") -> str:
    st = "(SELECT corr_id, probe_idx, t, greatest(0, least(1, inc_exp / inc_sim)) AS y FROM inc WHERE inc_sim >= threshold)"
    return f"""WITH sync AS MATERIALIZED (SELECT * FROM {_SYNC} s0), inc AS MATERIALIZED (SELECT * FROM {_INC} i0), st AS MATERIALIZED (SELECT * FROM {st} s1),
 fs AS (SELECT corr_id, probe_idx, min(t) AS t_stable, arg_min(y, t) AS f_stable, count(*) AS n_stable FROM st GROUP BY 1, 2),
 fr AS (SELECT * FROM {pchip_sql('SELECT * FROM st', 'SELECT corr_id, probe_idx, t FROM inc', KEYS, 'f_raw')} p),
 fac AS MATERIALIZED (SELECT inc.*, CASE WHEN inc.t <= t_stable OR n_stable = 1 THEN f_stable ELSE greatest(0, least(1, f_raw)) END AS factor FROM inc JOIN fs USING (corr_id, probe_idx) LEFT JOIN fr USING (corr_id, probe_idx, t))"""


@query("W8_factor_curve", f"""{_factor()} SELECT corr_id, probe_idx, i, {R('factor')} AS factor, {R('base_exp - base_sim')} AS offset_c, {R('threshold')} AS threshold, {R('base_sim + (base_exp - base_sim) + factor * inc_sim')} AS sim_corr FROM fac""")
def factor_curve(spark, d):
    e, s = curves(spark, d)
    f = C.factor_curve(C.synchronise(e, s, KEYS, N), KEYS)
    return f.select(*KEYS, "i", *[rnd(c).alias(c) for c in ("factor", "offset_c", "threshold", "sim_corr")])


@query("A12_rmse", f"{_factor()} SELECT corr_id, probe_idx, {R('sqrt(avg((base_exp + factor * inc_sim - y_exp) * (base_exp + factor * inc_sim - y_exp)))')} AS rmse FROM fac GROUP BY 1, 2")
def rmse(spark, d):
    e, s = curves(spark, d)
    f = C.factor_curve(C.synchronise(e, s, KEYS, N), KEYS)
    return f.groupBy(*KEYS).agg(rnd(C.rmse(F.col("sim_corr"), F.col("y_exp"))).alias("rmse"))


@query("A13_polynomial_fit_line", f"""SELECT corr_id, probe_idx, CAST(1 AS INT) AS degree, {R('regr_slope(y, t)', 7)} AS slope, {R('regr_intercept(y, t)', 3)} AS intercept FROM ({_clean(0)}) c GROUP BY 1, 2 HAVING count(*) >= 2""")
def polynomial_line(spark, d):
    _, s = curves(spark, d)
    f = C.polynomial_fit(s, KEYS, 1).where("size(poly) = 2")
    return f.select(*KEYS, "degree", rnd(F.col("poly")[0], 7).alias("slope"), rnd(F.col("poly")[1], 3).alias("intercept"))


@query("A13_polynomial_fit")
def polynomial_fit(spark, d):
    e, s = curves(spark, d)
    sync = C.synchronise(e, s, KEYS, N).withColumn("delta", F.col("y_sim") - F.col("y_exp"))
    return C.polynomial_fit(sync, KEYS, 6, y="delta").select(*KEYS, "degree", F.array_join(F.transform("poly", lambda v: F.format_string("%.6e", v)), ",").alias("poly"))


@query("A24_correction_horizon", f"""SELECT corr_id, {R('max(t0 + hi)')} AS horizon_min FROM (SELECT corr_id, probe_idx, min(t_min) AS t0, max(t_min) - min(t_min) AS hi FROM ({CURVE}) c WHERE side = 0 GROUP BY 1, 2) z GROUP BY 1""")
def correction_horizon(spark, d):
    c = view(spark, d, S.CURVE).where("side = 0").groupBy(*KEYS).agg(F.min("t_min").alias("t_origin"), (F.max("t_min") - F.min("t_min")).alias("t_last"))
    return C.horizon_minutes(c).withColumn("horizon_min", rnd("horizon_min"))


@query("C5_applied_adjustment", f"""{_factor()} SELECT corr_id, probe_idx, i, {R("CASE WHEN i % 2 = 0 THEN base_sim + (base_exp - base_sim) + factor * inc_sim - y_sim ELSE -(0.5 * t / 1000 + 2) END")} AS ajuste FROM fac""")
def applied_adjustment(spark, d):
    e, s = curves(spark, d)
    f = C.factor_curve(C.synchronise(e, s, KEYS, N), KEYS)
    corrected = F.when(F.col("i") % 2 == 0, F.col("sim_corr"))
    return f.select(*KEYS, "i", rnd(C.adjustment(corrected, F.col("y_sim"), F.array(F.lit(0.5), F.lit(2.0)), F.col("t") / 1000)).alias("ajuste"))


@query("C33_legacy_upgrade", f"""WITH sync AS MATERIALIZED (SELECT * FROM {_SYNC} s0), inc AS (SELECT *, max(CASE WHEN inc_sim >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY corr_id, probe_idx) AS ok FROM {_INC} i0) SELECT corr_id, probe_idx, i, {R('y_exp')} AS y_exp, {R('y_sim')} AS y_sim FROM inc WHERE ok = 1""")
def legacy_upgrade(spark, d):
    e, s = curves(spark, d)
    f = C.factor_curve(C.synchronise(e, s, KEYS, N), KEYS)
    gone = F.col("i") % 3 == 0
    old = f.withColumns({"y_exp": F.when(~gone, F.col("y_exp")), "y_sim": F.when(~gone, F.col("y_sim"))})
    return C.upgrade_legacy(old).select(*KEYS, "i", rnd("y_exp").alias("y_exp"), rnd("y_sim").alias("y_sim"))


ZC = f"SELECT corr_id, probe_idx - 1 AS zone_id, t_min AS t, max(t_c) AS y_exp, CASE WHEN max(seq) % 2 = 0 THEN min(t_c) END AS y_sim, CASE WHEN max(seq) % 3 = 0 THEN 0.5E0 END AS factor FROM (SELECT *, floor(t_min / 1440) AS day FROM ({S.CURVE}) c0) c GROUP BY corr_id, probe_idx, t_min"
ZD = f"SELECT corr_id, zone_id, floor(t / 1440) * 1440.0E0 AS t, max(y_exp) AS y_exp, min(y_sim) AS y_sim, min(factor) AS factor FROM ({ZC}) z GROUP BY corr_id, zone_id, floor(t / 1440)"


@query("C34_zone_curve", f"""WITH z AS ({sub(ZD)}) SELECT g.corr_id, g.t, CAST(2 AS INT) AS zone_id, coalesce(a.y_exp, g.y_exp) AS y_exp, coalesce(a.y_sim, g.y_sim) AS y_sim, coalesce(a.factor, g.factor) AS factor, 'Zona 2 [21.9, inf] mm' AS etiqueta
FROM z g LEFT JOIN z a ON a.corr_id = g.corr_id AND a.t = g.t AND a.zone_id = 2 WHERE g.zone_id = 0""")
def zone_curve(spark, d):
    z = C.zone_curve(view(spark, d, ZD), 2)
    return z.withColumn("etiqueta", C.zone_label(F.col("zone_id"), F.lit(21.9), F.lit(None).cast("double")))


@query("W16_ssa_factor_model")
def ssa_model(spark, d):
    e, s = curves(spark, d)
    f = C.factor_curve(C.synchronise(e, s, KEYS, N), KEYS)
    m = FL.ssa_models(f.select("corr_id", F.col("probe_idx").alias("zone_id"), "t", F.col("factor").alias("f")))
    return m.select("corr_id", "zone_id", "method", rnd("t_start").alias("t_start"), rnd("f_start", 4).alias("f_start"), "window", "rank", rnd("low", 4).alias("low"), rnd("high", 4).alias("high"))


@query("W17_ssa_forecast")
def ssa_forecast(spark, d):
    e, s = curves(spark, d)
    f = C.factor_curve(C.synchronise(e, s, KEYS, N), KEYS)
    knots = f.select("corr_id", F.col("probe_idx").alias("zone_id"), "t", F.col("factor").alias("f"))
    ends = knots.groupBy("corr_id", "zone_id").agg(F.max("t").alias("t_b"))
    at = ends.select("corr_id", "zone_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"), "t_b").select(
        "corr_id", "zone_id", F.col("k").cast("double").alias("t_min"), (F.col("t_b") + F.col("k") * 500).alias("t_rel"))
    return FL.forecast(FL.ssa_models(knots), at).withColumn("f_out", rnd("f_out", 4))


_ZONED = f"""zn AS (SELECT corr_id, least(max(probe_idx) FILTER (side = 0), max(probe_idx) FILTER (side = 1), 4) AS n FROM ({CURVE}) c GROUP BY 1),
 zo AS (SELECT corr_id, z AS zone_id, greatest(1, z) AS probe_idx, CASE z WHEN 1 THEN 18.6 WHEN 2 THEN 25.2 WHEN 3 THEN 31.8 WHEN 4 THEN 38.4 END AS depth FROM zn, range(5) r(z) WHERE z = 0 OR n >= 2 AND z <= n),
 ze AS (SELECT *, (lag(depth) OVER w + depth) / 2 AS z_min, (depth + lead(depth) OVER w) / 2 AS z_max, zone_id = 0 OR lead(depth) OVER w IS NULL AS top FROM zo WINDOW w AS (PARTITION BY corr_id, zone_id > 0 ORDER BY zone_id)),
 zf AS (SELECT corr_id, probe_idx, max(base_exp - base_sim) AS offset_c, max(y_exp) AS y_max, count(*) AS n, sqrt(avg(pow(base_exp + factor * inc_sim - y_exp, 2))) AS rmse FROM fac GROUP BY 1, 2),
 zt AS (SELECT corr_id, probe_idx, min(t_min) AS t_origin FROM ({CURVE}) c WHERE side = 0 GROUP BY 1, 2)"""


@query("C4_calibrate", f"""{_factor()}, {_ZONED} SELECT corr_id, CAST(zone_id AS INT) AS zone_id, CAST(z_min AS DOUBLE) AS z_min, CAST(z_max AS DOUBLE) AS z_max, top, t_origin, {R('offset_c', 4)} AS offset_c, {R('max(y_max) OVER (PARTITION BY corr_id)', 4)} AS exp_max, CAST(least(6, n - 1) AS INT) AS degree, {R('rmse', 4)} AS rmse_factor
 FROM ze JOIN zf USING (corr_id, probe_idx) JOIN zt USING (corr_id, probe_idx)""")
def calibrate(spark, d):
    c = view(spark, d, S.CURVE)
    parts = CAL.calibrate(c.where("side = 0"), c.where("side = 1"), N)
    z = parts["zones"].join(parts["fits"].select("corr_id", "zone_id", "degree", "rmse_poly", "rmse_factor"), ["corr_id", "zone_id"])
    return z.select("corr_id", "zone_id", "z_min", "z_max", "top", "t_origin", rnd("offset_c", 4).alias("offset_c"), rnd("exp_max", 4).alias("exp_max"), "degree", rnd("rmse_factor", 4).alias("rmse_factor"))
