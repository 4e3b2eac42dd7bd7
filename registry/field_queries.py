"""Point-field operators: filters, statistics, zones, look-ups, the correction and its composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.functions import nulls
from thermal_lake.operators import field as FL
from thermal_lake.operators import mesh as ME
from thermal_lake.plans import correct as CO

from . import standins as S
from .core import R, query, rnd, sub, table, view
from .curve_queries import pchip_sql

FIELD, RAW, INST = sub(S.FIELD), sub(S.FIELD_RAW), sub(S.INSTANTS)
DS = ["modelo", "dataset"]


@query("F1_finite_points", f"SELECT sid, point_id, t_idx, t_raw FROM ({RAW}) f WHERE NOT isnan(t_raw)")
def finite_points(spark, d):
    return nulls.finite_points(view(spark, d, S.FIELD_RAW), "t_raw").select("sid", "point_id", "t_idx", "t_raw")


@query("F4_temperature_window", f"""SELECT sid, point_id, t_idx, t_c FROM (SELECT *, count(*) OVER (PARTITION BY sid, t_idx) AS n FROM ({FIELD}) f WHERE t_c BETWEEN 100 AND 120) t WHERE n >= 4""")
def temperature_window(spark, d):
    return FL.temperature_window(view(spark, d, S.FIELD), F.lit(100.0), F.lit(120.0)).select("sid", "point_id", "t_idx", "t_c")


@query("F5_ablation_threshold", f"SELECT sid, point_id, t_idx FROM ({FIELD}) f WHERE t_c >= coalesce(CASE WHEN sid % 3 = 0 THEN 70.0 END, CASE WHEN sid % 2 = 0 THEN 55.0 END, 60.0)")
def ablation_threshold(spark, d):
    cfg, meta = F.when(F.col("sid") % 3 == 0, 70.0), F.when(F.col("sid") % 2 == 0, 55.0)
    return view(spark, d, S.FIELD).where(FL.ablated(F.col("t_c"), cfg, meta)).select("sid", "point_id", "t_idx")


@query("F6_cylinder_domain", f"SELECT sid, point_id, t_idx FROM ({FIELD}) f WHERE sqrt(x * x + y * y) <= 15 + 1e-9 AND z >= 5 - 1e-9 AND z <= 36 + 1e-9")
def cylinder_domain(spark, d):
    return view(spark, d, S.FIELD).where(FL.in_cylinder(F.col("x"), F.col("y"), F.col("z"), 15.0, 5.0, 36.0)).select("sid", "point_id", "t_idx")


_BOX = "min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi"


@query("F6_domain_limits", f"""SELECT * FROM (SELECT modelo, dataset, greatest(x_lo, -15.0E0) AS x_lo, least(x_hi, 15.0E0) AS x_hi, greatest(y_lo, -15.0E0) AS y_lo, least(y_hi, 15.0E0) AS y_hi, greatest(z_lo, 3.0E0) AS z_lo, least(z_hi, 36.0E0) AS z_hi
FROM (SELECT modelo, dataset, {_BOX} FROM ({FIELD}) f GROUP BY 1, 2) b) t WHERE x_hi > x_lo AND y_hi > y_lo AND z_hi > z_lo""")
def domain_limits(spark, d):
    return FL.domain_limits(view(spark, d, S.FIELD), DS, 15.0, 3.0, 36.0)


@query("P14_kelvin_to_celsius", f"""SELECT sid, t_idx, point_id, {R('CASE WHEN min(k) OVER (PARTITION BY sid, t_idx) > 200 THEN k - 273.15 ELSE k END')} AS t_c FROM (SELECT *, t_c + CASE WHEN sid % 3 = 0 THEN 273.15 ELSE 0 END AS k FROM ({FIELD}) f) t""")
def kelvin(spark, d):
    f = view(spark, d, S.FIELD).withColumn("t_c", F.col("t_c") + F.when(F.col("sid") % 3 == 0, 273.15).otherwise(0))
    return FL.to_celsius(f, ["sid", "t_idx"]).select("sid", "t_idx", "point_id", rnd("t_c").alias("t_c"))


@query("P15_time_units", f"""SELECT sid, t_idx, {R('CASE WHEN max(t) OVER (PARTITION BY sid) > 5000 THEN t / 1000 / 60 WHEN max(t) OVER (PARTITION BY sid) > 60 THEN t / 60 ELSE t END', 9)} AS t_min FROM (SELECT sid, t_idx, t_min * CASE sid % 3 WHEN 0 THEN 60000 WHEN 1 THEN 60 ELSE 1 END AS t FROM ({INST}) i) q""")
def time_units(spark, d):
    k = F.when(F.col("sid") % 3 == 0, 60000).when(F.col("sid") % 3 == 1, 60).otherwise(1)
    i = view(spark, d, S.INSTANTS).select("sid", "t_idx", (F.col("t_min") * k).alias("t"))
    return FL.to_minutes(i, ["sid"]).select("sid", "t_idx", rnd("t_min", 9).alias("t_min"))


_TF = "CASE WHEN sid % 3 = 0 THEN t_min WHEN sid % 3 = 1 AND t_idx % 2 = 0 THEN t_min * 2 END"
_TD = "CASE WHEN sid % 5 = 0 THEN t_min + 10 END"


def _spread(src: str) -> str:
    w = "OVER (PARTITION BY sid)"
    return f"""CASE WHEN count({src}) {w} = count(*) {w} THEN {src} ELSE first_value({src}) OVER (PARTITION BY sid ORDER BY CASE WHEN {src} IS NULL THEN 1 ELSE 0 END, t_idx) + (first_value({src}) OVER (PARTITION BY sid ORDER BY CASE WHEN {src} IS NULL THEN 1 ELSE 0 END, t_idx DESC)
 - first_value({src}) OVER (PARTITION BY sid ORDER BY CASE WHEN {src} IS NULL THEN 1 ELSE 0 END, t_idx)) * (t_idx - min(t_idx) {w}) / greatest(1, count(*) {w} - 1) END"""


@query("P16_time_vector_fallback", f"""SELECT sid, t_idx, {R(f"CASE WHEN count(a) OVER (PARTITION BY sid) > 0 THEN {_spread('a')} WHEN count(b) OVER (PARTITION BY sid) > 0 THEN {_spread('b')} ELSE t_idx - min(t_idx) OVER (PARTITION BY sid) END")} AS t_min FROM (SELECT sid, t_idx, {_TF} AS a, {_TD} AS b FROM ({INST}) i) q""")
def time_fallback(spark, d):
    i = view(spark, d, S.INSTANTS).select("sid", "t_idx", F.expr(_TF).alias("a"), F.expr(_TD).alias("b"))
    return FL.time_fallback(i, ["sid"], "t_idx", ["a", "b"]).select("sid", "t_idx", rnd("t_min").alias("t_min"))


@query("P25_blended_factor", f"SELECT sid, point_id, t_idx, {R('1 + k * (0.8 - 1)')} AS factor, {R('k * -2.5')} AS offset_c FROM (SELECT *, (sid % 5) / 4.0 AS k FROM ({FIELD}) f) t")
def blended(spark, d):
    f, o = FL.blended(F.lit(0.8), F.lit(-2.5), (F.col("sid") % 5) / 4.0)
    return view(spark, d, S.FIELD).select("sid", "point_id", "t_idx", rnd(f).alias("factor"), rnd(o).alias("offset_c"))


@query("P29_probe_coordinate_aliases", f"SELECT sid, point_id, t_idx, CASE sid % 3 WHEN 0 THEN x WHEN 1 THEN y END AS x0, sid % 3 = 2 AS global FROM ({FIELD}) f")
def coordinate_aliases(spark, d):
    c = F.col
    nan = F.lit(float("nan"))
    a = F.array(c("x"), F.when(c("sid") % 3 == 0, c("y")).otherwise(nan), c("z"))
    b = F.when(c("sid") % 3 == 1, F.array(c("y"), c("x"), c("z")))
    short = F.array(c("x"), c("y"))
    xyz = FL.probe_coordinate(short, a, b)
    return view(spark, d, S.FIELD).select("sid", "point_id", "t_idx", xyz[0].alias("x0"), xyz.isNull().alias("global"))


@query("J2_zone_interval_join", f"""SELECT f.sid, f.point_id, f.t_idx, CAST(z.zone_id AS INT) AS zone_id FROM ({FIELD}) f JOIN supplier s ON s.s_suppkey = f.sid JOIN ({sub(S.ZONES)}) z ON z.corr_id = s.s_nationkey
 AND (z.z_min IS NULL OR f.z >= z.z_min) AND (z.z_max IS NULL OR f.z < z.z_max)""")
def zone_join(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").cast("long").alias("corr_id"))
    return FL.join_zones(view(spark, d, S.FIELD).join(s, "sid"), view(spark, d, S.ZONES), ["corr_id"]).select("sid", "point_id", "t_idx", "zone_id")


DEPTH = "SELECT s_suppkey AS corr_id, CAST(z.zone_id AS INT) AS zone_id, z.depth + s_suppkey % 3 AS depth FROM {supplier} CROSS JOIN (VALUES (1, 18.6E0), (2, 25.2E0), (3, 31.8E0), (4, 38.4E0)) AS z(zone_id, depth) WHERE z.zone_id <= s_suppkey % 4 + 1"


@query("J3_zone_edges", f"""SELECT corr_id, zone_id, {R('(lag(depth) OVER w + depth) / 2')} AS z_min, {R('(depth + lead(depth) OVER w) / 2')} AS z_max FROM ({sub(DEPTH)}) q WINDOW w AS (PARTITION BY corr_id ORDER BY zone_id)""")
def zone_edges(spark, d):
    return FL.zone_edges(view(spark, d, DEPTH), ["corr_id"]).select("corr_id", "zone_id", rnd("z_min").alias("z_min"), rnd("z_max").alias("z_max"))


@query("J5_nearest_time", f"""SELECT DISTINCT sid, t_idx FROM (SELECT sid, t_idx, row_number() OVER (PARTITION BY sid, m ORDER BY abs(t_min - m), t_idx) AS rn FROM ({INST}) i, (VALUES (0.4), (2.5), (3.0), (11.0)) v(m)) t WHERE rn = 1""")
def nearest_time(spark, d):
    return FL.nearest_instants(view(spark, d, S.INSTANTS), [0.4, 2.5, 3.0, 11.0], ["sid"]).select("sid", "t_idx")


# Probes slightly off the grid; nodes are the field's points with their number of finite instants.
NODES = f"SELECT sid, point_id, x, y, z, count(t_c) AS n_finite FROM ({S.FIELD}) f GROUP BY sid, point_id, x, y, z"
OFF = "SELECT s_suppkey AS sid, CAST(s_suppkey % 2 AS INT) AS pid, s_suppkey % 40 - 19.63E0 AS x, s_suppkey % 20 - 9.71E0 AS y, s_suppkey % 45 + 0.37E0 AS z FROM {supplier}"


@query("J6_nearest_node_fallback", f"""SELECT sid, pid, point_id, {R('dist')} AS distance, n_finite FROM (SELECT *, row_number() OVER (PARTITION BY sid, pid ORDER BY n_finite DESC, dist, point_id) AS best FROM
 (SELECT p.sid, p.pid, n.point_id, n.n_finite, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2 + (p.z - n.z) ** 2) AS dist, row_number() OVER (PARTITION BY p.sid, p.pid ORDER BY sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2 + (p.z - n.z) ** 2), n.point_id) AS rn FROM ({sub(OFF)}) p JOIN ({sub(NODES)}) n USING (sid)) t WHERE rn <= 250 AND n_finite > 0) u WHERE best = 1""")
def nearest_node(spark, d):
    nodes = view(spark, d, NODES)
    best = ME.nearest_finite(view(spark, d, OFF), nodes, ["sid"], "pid", "point_id")
    return best.select("sid", "pid", "point_id", rnd("distance").alias("distance"), "n_finite")


@query("A1_instant_statistics", f"""SELECT sid, t_idx, min(t_c) AS t_min_c, max(t_c) AS t_max_c, count(t_c) AS n_total, count(*) FILTER (t_c >= 55) AS n_filtered, count(*) FILTER (t_c >= 120) AS n_carbon FROM ({FIELD}) f WHERE t_c IS NOT NULL GROUP BY 1, 2""")
def instant_stats(spark, d):
    return FL.instant_stats(view(spark, d, S.FIELD), ["sid", "t_idx"], t_carbon=120.0)


@query("A2_volume_curve", f"SELECT sid, t_idx, {R('count(*) FILTER (t_c >= 60) * 12.5E0')} AS volume FROM ({FIELD}) f GROUP BY 1, 2")
def volume_curve(spark, d):
    return FL.volume_curve(view(spark, d, S.FIELD), 12.5, keys=["sid", "t_idx"]).withColumn("volume", rnd("volume"))


@query("A3_axis_step", f"""WITH p AS (SELECT DISTINCT sid, a.axis, CASE a.axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS v FROM ({FIELD}) f, (VALUES ('x'), ('y'), ('z')) a(axis)), q AS (SELECT *, v - lag(v) OVER (PARTITION BY sid, axis ORDER BY v) AS s FROM p),
 m AS (SELECT sid, axis, coalesce(median(CASE WHEN s > 0 THEN s END), 1.0) AS step FROM q GROUP BY 1, 2) SELECT sid, max(step) FILTER (axis = 'x') AS dx, max(step) FILTER (axis = 'y') AS dy, max(step) FILTER (axis = 'z') AS dz FROM m GROUP BY 1""")
def axis_step(spark, d):
    return FL.axis_steps(view(spark, d, S.FIELD), ["sid"])


@query("A4_bounding_box", f"""SELECT sid, {', '.join(f"{R(f'min({a}) - 0.05 * (max({a}) - min({a}))')} AS {a}_lo, {R(f'max({a}) + 0.05 * (max({a}) - min({a}))')} AS {a}_hi" for a in 'xyz')} FROM ({FIELD}) f GROUP BY 1""")
def bounding_box(spark, d):
    b = FL.bounding_box(view(spark, d, S.FIELD), ["sid"], 0.05)
    return b.select("sid", *[rnd(c).alias(c) for c in b.columns if c != "sid"])


def _sig(cols) -> str:
    parts = "'v1', CAST(count(*) AS VARCHAR)"
    for c in cols:
        parts += (f", CAST(count({c}) AS VARCHAR), coalesce(CAST(CAST(min({c}) AS DECIMAL(28,6)) AS VARCHAR), '-'), coalesce(CAST(CAST(max({c}) AS DECIMAL(28,6)) AS VARCHAR), '-'),"
                  f" coalesce(CAST(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DECIMAL(38,6)) AS VARCHAR), '-')")
    return f"sha256(concat_ws('|', {parts}))"


@query("A5_content_signature", f"SELECT sid, t_idx, {_sig(['x', 'z', 't_c'])} AS signature FROM ({FIELD}) f GROUP BY 1, 2")
def content_signature(spark, d):
    return FL.content_signature(view(spark, d, S.FIELD), ["sid", "t_idx"], ["x", "z", "t_c"], "v1")


@query("A10_experimental_ceiling", f"SELECT corr_id, max(t_c) AS exp_max FROM ({sub(S.CURVE)}) c WHERE side = 1 GROUP BY 1")
def experimental_ceiling(spark, d):
    return FL.experimental_ceiling(view(spark, d, S.CURVE).where("side = 1").withColumnRenamed("t_c", "y_exp"))


@query("A11_corrected_cap", f"SELECT corr_id, least(CASE WHEN corr_id % 2 = 0 THEN 70.0 ELSE 120.0 END, 120.0, max(t_c)) AS cap FROM ({sub(S.CURVE)}) c WHERE side = 1 GROUP BY corr_id")
def corrected_cap(spark, d):
    e = FL.experimental_ceiling(view(spark, d, S.CURVE).where("side = 1").withColumnRenamed("t_c", "y_exp"))
    return e.select("corr_id", FL.corrected_cap(F.when(F.col("corr_id") % 2 == 0, 70.0), F.col("exp_max")).alias("cap"))


@query("A21_adaptive_radius", f"SELECT sid, t_idx, {R('greatest(2.0, 2.2 * cbrt((max(x) - min(x) + 2.220446049250313e-16) * (max(y) - min(y) + 2.220446049250313e-16) * (max(z) - min(z) + 2.220446049250313e-16) / count(*)))')} AS radius FROM ({FIELD}) f GROUP BY 1, 2")
def adaptive_radius(spark, d):
    return FL.adaptive_radius(view(spark, d, S.FIELD), ["sid", "t_idx"]).withColumn("radius", rnd("radius"))


@query("W1_sustained_cutoff", f"""WITH i AS (SELECT *, coalesce(t_max_c > 128, false) AS f FROM ({INST}) q), s AS (SELECT *, min(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t_min ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok FROM i) SELECT sid, min(CASE WHEN ok = 1 THEN t_min END) AS cutoff FROM s GROUP BY 1""")
def sustained_cutoff(spark, d):
    return FL.sustained_cutoff(view(spark, d, S.INSTANTS), F.col("t_max_c") > 128, ["sid"])


@query("W2_sustained_carbonisation", f"""WITH i AS ({INST}), n AS (SELECT sid, arg_min(t_min, abs(t_min - 1) * 1000 + t_idx) AS t1, min(abs(t_min - 1)) AS dt FROM i GROUP BY 1) SELECT sid, bool_and(coalesce(t_max_c > CASE WHEN sid % 9 = 0 THEN 130 ELSE 120 END, false)) AND min(dt) <= 0.51 AS carbon FROM i JOIN n USING (sid) WHERE t_min >= t1 - 1e-9 GROUP BY 1""")
def sustained_carbon(spark, d):
    return FL.sustained_carbon(view(spark, d, S.INSTANTS), F.when(F.col("sid") % 9 == 0, 130).otherwise(120), ["sid"])


@query("W9_base_value", f"SELECT sid, point_id, t_idx, first_value(t_c) OVER (PARTITION BY sid, point_id ORDER BY t_idx) AS t_base FROM ({FIELD}) f")
def base_value(spark, d):
    return FL.first_temperature(view(spark, d, S.FIELD), ["sid", "point_id"]).select("sid", "point_id", "t_idx", "t_base")


@query("W15_time_plan", f"""SELECT sid, t_idx, CAST(row_number() OVER (PARTITION BY sid ORDER BY t NULLS LAST, t_idx) AS INT) AS pos, CASE WHEN t_max_c IS NULL THEN t_max_meta WHEN t_max_meta IS NULL THEN t_max_c ELSE greatest(t_max_c, t_max_meta) END AS t_max_decision FROM (SELECT *, CASE WHEN (sid + t_idx) % 4 > 0 THEN 10 - t_min END AS t FROM ({INST}) i) q""")
def time_plan(spark, d):
    i = view(spark, d, S.INSTANTS).withColumn("t_min", F.when((F.col("sid") + F.col("t_idx")) % 4 > 0, 10 - F.col("t_min")))
    return FL.time_plan(i, ["sid"]).select("sid", "t_idx", "pos", "t_max_decision")


@query("F15_horizon_filter", f"""SELECT sid, point_id, t_idx FROM (SELECT *, bool_or(t_c IS NOT NULL AND t_min <= h + 1e-9) OVER (PARTITION BY sid) AS hit, h FROM (SELECT * EXCLUDE (t_min), 3 AS h, t_min + CASE WHEN sid % 4 = 0 THEN 3.5 ELSE 0 END AS t_min FROM ({FIELD}) f0) f) t WHERE NOT hit OR t_min <= h + 1e-9""")
def horizon_filter(spark, d):
    late = view(spark, d, S.FIELD).withColumn("t_min", F.col("t_min") + F.when(F.col("sid") % 4 == 0, 3.5).otherwise(0.0))  # these begin after the horizon
    return FL.within_horizon(late, 3.0, ["sid"]).select("sid", "point_id", "t_idx")


@query("O3_even_sample", f"""WITH r AS (SELECT sid, t_idx, point_id, row_number() OVER (PARTITION BY sid, t_idx ORDER BY point_id) AS rn, count(*) OVER (PARTITION BY sid, t_idx) AS n FROM ({FIELD}) f), k AS (SELECT DISTINCT sid, t_idx, floor(1 + (n - 1) * k / 29.0 + 0.5) AS rn FROM r, range(30) q(k) WHERE n > 30)
SELECT r.sid, r.t_idx, r.point_id FROM r LEFT JOIN k USING (sid, t_idx, rn) WHERE n <= 30 OR k.rn IS NOT NULL""")
def even_sample(spark, d):
    return FL.even_sample(view(spark, d, S.FIELD), ["sid", "t_idx"], "point_id", 30).select("sid", "t_idx", "point_id")


@query("O4_stride_sample", f"SELECT sid, t_idx, point_id FROM (SELECT *, row_number() OVER (PARTITION BY sid, t_idx ORDER BY point_id) AS rn, greatest(1, floor(count(*) OVER (PARTITION BY sid, t_idx) / 20)) AS step FROM ({FIELD}) f) t WHERE (rn - 1) % step = 0")
def stride_sample(spark, d):
    return FL.stride_sample(view(spark, d, S.FIELD), ["sid", "t_idx"], "point_id", 20).select("sid", "t_idx", "point_id")


@query("O5_top_k_nearest", f"SELECT sid, t_idx, point_id, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY sid, t_idx ORDER BY sqrt(x * x + y * y + z * z), point_id) AS rn FROM ({FIELD}) f) t WHERE rn <= 10")
def top_k(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return FL.top_nearest(view(spark, d, S.FIELD), ["sid", "t_idx"], r, 10, ["point_id"]).select("sid", "t_idx", "point_id", "rn")


# ---------------------------------------------------------------- correction

_KN = f"SELECT corr_id, zone_id, t, f AS y FROM ({sub(S.KNOTS)}) kn"
_AT = f"SELECT DISTINCT corr_id, zone_id, least(CAST(t_idx AS DOUBLE) - 1, 4.4) AS t FROM range(7) r(t_idx), ({sub(S.ZONES)}) z"
_FAC = f"(SELECT corr_id, zone_id, t, greatest(0, least(1, f)) AS f FROM {pchip_sql(_KN, _AT, ['corr_id', 'zone_id'], 'f')} q)"


def corrected_sql(k: float = 1.0, cap: str = "120") -> str:
    """Field rows of all pairs with t_base and t_corr (correction of the supplier's nation)."""
    return f"""(SELECT f.*, p.corr_id, least(CASE WHEN f.t_min - z.t_origin >= -1e-9 THEN f.t_base + {k} * z.offset_c + (1 + {k} * (fa.f - 1)) * (f.t_c - f.t_base) ELSE f.t_c END,
   CASE WHEN f.t_c IS NULL OR (f.t_min - z.t_origin >= -1e-9 AND f.t_base IS NULL) THEN NULL ELSE least({cap}, 120, z.exp_max) END) AS t_corr, f.t_min - z.t_origin AS t_rel
 FROM (SELECT *, first_value(t_c) OVER (PARTITION BY sid, point_id ORDER BY t_idx) AS t_base FROM ({FIELD}) f0) f JOIN ({sub(S.PAIRS)}) p USING (modelo, dataset)
 JOIN ({sub(S.ZONES)}) z ON z.corr_id = p.corr_id AND (z.z_min IS NULL OR f.z >= z.z_min) AND (z.z_max IS NULL OR f.z < z.z_max)
 JOIN {_FAC} fa ON fa.corr_id = p.corr_id AND fa.zone_id = z.zone_id AND fa.t = least(f.t_min - 1, 4.4))"""


def corrected(spark, d, **options):
    f = view(spark, d, S.FIELD)
    zones = view(spark, d, S.ZONES)
    return CO.correct_field(f, view(spark, d, S.PAIRS), zones, view(spark, d, S.KNOTS), instants=view(spark, d, S.TIMES), **options)


@query("C1_corrected_volume_curve", f"SELECT modelo, dataset, corr_id, t_idx, {R('count(*) FILTER (t_c >= 60) * 12.5E0')} AS v_base, {R('count(*) FILTER (t_corr >= 60) * 12.5E0')} AS v_corr, {R('max(t_corr)')} AS t_max_corr FROM {corrected_sql()} q GROUP BY 1, 2, 3, 4")
def corrected_volume(spark, d):
    keys = [*DS, "corr_id", "t_idx"]
    return corrected(spark, d).groupBy(*keys).agg(
        rnd(F.count_if(F.col("t_c") >= 60) * 12.5).alias("v_base"), rnd(F.count_if(F.col("t_corr") >= 60) * 12.5).alias("v_corr"), rnd(F.max("t_corr")).alias("t_max_corr"))


@query("C1_apply_correction", f"SELECT modelo, dataset, corr_id, point_id, t_idx, {R('t_corr')} AS t_corr FROM {corrected_sql(0.5, '90')} q")
def apply_correction(spark, d):
    return corrected(spark, d, intensity=0.5, cap_c=90.0).select(*DS, "corr_id", "point_id", "t_idx", rnd("t_corr").alias("t_corr"))


@query("C2_rebuilt_snapshots", f"""SELECT modelo, dataset, corr_id, t_idx, {R('min(t_corr)')} AS t_min_c, {R('max(t_corr)')} AS t_max_c, count(t_corr) AS n_total, count(*) FILTER (t_corr >= 60) AS n_filtered, max(t_rel) AS t_rel FROM {corrected_sql()} q GROUP BY 1, 2, 3, 4""")
def rebuilt_snapshots(spark, d):
    _, stats = FL.rebuilt_snapshots(corrected(spark, d))
    return stats.withColumns({"t_min_c": rnd("t_min_c"), "t_max_c": rnd("t_max_c")})


@query("C2_corrected_probes", f"SELECT modelo, dataset, corr_id, 'S' || CAST(point_id AS VARCHAR) AS probe, t_idx, t_c AS t_c_original, {R('t_corr')} AS t_c FROM {corrected_sql()} q")
def corrected_probes(spark, d):
    p = view(spark, d, S.FIELD).withColumn("probe", F.concat(F.lit("S"), F.col("point_id").cast("string"))).drop("point_id")
    out = CO.correct_probes(p, view(spark, d, S.PAIRS), view(spark, d, S.ZONES), view(spark, d, S.KNOTS))
    return out.select(*DS, "corr_id", "probe", "t_idx", "t_c_original", rnd("t_c").alias("t_c"))


@query("C2_snapshot_correction", f"""SELECT modelo, dataset, corr_id, t_idx, {R('max(t_corr)')} AS t_max_c, count(t_corr) AS n FROM {corrected_sql().replace('first_value(t_c) OVER (PARTITION BY sid, point_id ORDER BY t_idx)', 'first_value(t_c) OVER (PARTITION BY sid, t_idx ORDER BY point_id)')} q GROUP BY 1, 2, 3, 4""")
def snapshot_correction(spark, d):
    out = CO.correct_snapshots(view(spark, d, S.FIELD), view(spark, d, S.PAIRS), view(spark, d, S.ZONES), view(spark, d, S.KNOTS))
    return out.groupBy(*DS, "corr_id", "t_idx").agg(rnd(F.max("t_corr")).alias("t_max_c"), F.count("t_corr").alias("n"))


@query("C3_mass_correction", f"""SELECT modelo, dataset, corr_id, count(t_corr) AS n, {R('max(t_corr)')} AS t_max_c, {R('min(t_corr)')} AS t_min_c FROM {corrected_sql()} q WHERE (modelo, dataset) NOT IN (SELECT (modelo, dataset) FROM ({FIELD}) f WHERE sid % 4 = 0) GROUP BY 1, 2, 3""")
def mass_correction(spark, d):
    f = view(spark, d, S.FIELD)
    pairs = view(spark, d, S.PAIRS)
    c = pairs.withColumns({"partition_key": F.concat_ws("__", *DS), "ruta": F.concat_ws("/", *DS)})
    sid = f.select(*DS, "sid").distinct()
    # One correction per nation and one catalogue key per dataset: the dataset's nation is its "antena".
    cat = c.select("ruta", *DS, "partition_key", F.lit("Monopolo").alias("tipo"), F.col("corr_id").cast("string").alias("antena"), F.lit(1.0).alias("caso"), F.lit(10.0).alias("potencia_w"))
    corr = pairs.select("corr_id").distinct().select("corr_id", F.lit(None).cast("string").alias("tipo"), F.col("corr_id").cast("string").alias("antena"), F.lit(1.0).alias("caso"),
                                                    F.lit(None).cast("double").alias("potencia_w"), F.lit("s1").alias("signature"))
    done = c.join(sid, DS).where("sid % 4 = 0").select(F.concat_ws("|", "partition_key", F.col("corr_id").cast("string")).alias("key"), F.lit("s1").alias("signature"))
    out, _, _ = CO.mass_correction(cat, corr, done, f, view(spark, d, S.ZONES), view(spark, d, S.KNOTS), instants=view(spark, d, S.TIMES))
    return out.groupBy(*DS, "corr_id").agg(F.count("t_corr").alias("n"), rnd(F.max("t_corr")).alias("t_max_c"), rnd(F.min("t_corr")).alias("t_min_c"))


# Clouds of every instant, their regions by passing the smallest point on to all 26 neighbours until nothing changes.
_CLOUDS = f"""WITH RECURSIVE kept AS (SELECT sid, t_idx, CAST(floor(point_id / 18) AS INT) AS ix, CAST(floor(point_id % 18 / 9) AS INT) AS iy, CAST(point_id % 9 AS INT) AS iz FROM (SELECT *, count(*) OVER (PARTITION BY sid, t_idx) AS nn FROM ({FIELD}) f0 WHERE t_c BETWEEN 90 AND 141) f WHERE nn >= 4),
 m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sid, t_idx, ix, iy, iz) AS p FROM kept),
 e AS MATERIALIZED (SELECT a.p AS a, b.p AS b FROM m a JOIN m b ON a.sid = b.sid AND a.t_idx = b.t_idx AND a.p <> b.p AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1),
 lab(p, l) USING KEY (p) AS (SELECT p, p FROM m UNION SELECT e.a, min(lab.l) FROM lab JOIN e ON e.b = lab.p JOIN recurring.lab r ON r.p = e.a GROUP BY e.a, r.l HAVING min(lab.l) < r.l),
 reg AS (SELECT sid, t_idx, count(DISTINCT l) AS n_regions FROM m JOIN lab USING (p) GROUP BY 1, 2),
 i AS (SELECT sid, t_idx, t_min, max(t_c) AS t_max_c, count(*) FILTER (t_c BETWEEN 90 AND 141) AS n_points FROM ({FIELD}) f GROUP BY 1, 2, 3),
 s AS (SELECT *, min(CASE WHEN coalesce(t_max_c > 141, false) THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t_min ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok FROM i),
 st AS (SELECT sid, t_idx, n_points, n_regions, CASE WHEN ok = 1 THEN 'corte' WHEN n_points < 4 THEN 'sin_puntos' WHEN coalesce(n_regions <> 1, false) THEN 'varias_regiones' ELSE 'exportar' END AS status FROM s LEFT JOIN reg USING (sid, t_idx))"""


def clouds(spark, d):
    return FL.cloud_status(view(spark, d, S.FIELD), F.lit(90.0), F.lit(141.0), ["sid"], spacing=(10.0, 20.0, 5.0))


@query("C14_thermal_cloud_status", f"{_CLOUDS} SELECT * FROM st")
def cloud_status(spark, d):
    return clouds(spark, d).select("sid", "t_idx", "n_points", "n_regions", "status")


@query("C14_cloud_outcomes", f"{_CLOUDS} SELECT sid, {', '.join(f'count(*) FILTER (status = {s!r}) AS {s}' for s in ('corte', 'sin_puntos', 'varias_regiones', 'exportar'))} FROM st GROUP BY 1")
def cloud_outcomes(spark, d):
    return FL.cloud_outcomes(clouds(spark, d), ["sid"])
