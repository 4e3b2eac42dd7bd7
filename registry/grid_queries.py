"""Grids: generation, sampling, resampling, extrapolation in time, slices and the 4-D analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.operators import field as FL
from thermal_lake.operators import grid as GR
from thermal_lake.plans import volume4d as V4

from . import standins as S
from .core import R, query, rnd, sub, table, view

GRID = sub(S.GRID)
KEY = ["dataset"]
SHAPE = f"SELECT dataset, min(x) AS x0, (max(x) - min(x)) / (count(DISTINCT x) - 1) AS dx, count(DISTINCT x) AS nx, min(y) AS y0, (max(y) - min(y)) / (count(DISTINCT y) - 1) AS dy, count(DISTINCT y) AS ny, min(z) AS z0, (max(z) - min(z)) / (count(DISTINCT z) - 1) AS dz, count(DISTINCT z) AS nz FROM ({GRID}) g WHERE t_c IS NOT NULL GROUP BY 1"
_BOX = ", ".join(f"min({a}) - 0.05 * (max({a}) - min({a})) AS {a}_lo, max({a}) + 0.05 * (max({a}) - min({a})) AS {a}_hi" for a in "xyz")
NX = (4, 3, 4)
TARGET = f"""SELECT dataset, CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, CAST(k AS INT) AS iz, x_lo + i * (x_hi - x_lo) / {NX[0] - 1} AS x, y_lo + j * (y_hi - y_lo) / {NX[1] - 1} AS y, z_lo + k * (z_hi - z_lo) / {NX[2] - 1} AS z
FROM (SELECT dataset, {_BOX} FROM ({GRID}) g GROUP BY 1) b, range({NX[0]}) a(i), range({NX[1]}) bb(j), range({NX[2]}) c(k)"""


def located_sql(points: str) -> str:
    cols = ", ".join(f"({a} - {a}0) / d{a} AS u{a}, greatest(0, least(CAST(floor(({a} - {a}0) / d{a}) AS INT), n{a} - 2)) AS c{a}" for a in "xyz")
    return f"(SELECT p.*, n0.nx, n0.ny, n0.nz, {cols} FROM ({points}) p JOIN ({SHAPE}) n0 USING (dataset))"


def trilinear_sql(points: str, ids: str, source: str = GRID, extra: str = "") -> str:
    """Weighted sum over the eight corners, one joined row per corner."""
    w = " * ".join(f"CASE WHEN k{a} = 1 THEN u{a} - c{a} ELSE 1 - (u{a} - c{a}) END" for a in "xyz")
    return f"""(SELECT {ids}, s.t_idx, s.t_min, CASE WHEN count(s.t_c) = 8 THEN sum(({w}) * s.t_c) END AS v FROM {located_sql(points)} p, (VALUES (0,0,0),(0,0,1),(0,1,0),(0,1,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1)) q(kx, ky, kz), ({source}) s
 WHERE s.dataset = p.dataset AND s.ix = p.cx + kx AND s.iy = p.cy + ky AND s.iz = p.cz + kz {extra} GROUP BY {ids}, s.t_idx, s.t_min HAVING count(s.t_c) = 8)"""


def shape(spark, d):
    return GR.grid_shape(view(spark, d, S.GRID), KEY)


def shape_at(spark, d):
    """The dataset's grid, for each of its instants."""
    return shape(spark, d).join(view(spark, d, S.GRID).select("dataset", "t_idx").distinct(), KEY)


@query("J11_regular_grid", f"SELECT dataset, ix, iy, iz, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM ({TARGET}) t")
def regular_grid(spark, d):
    g = GR.linspace_grid(FL.bounding_box(view(spark, d, S.GRID), KEY, 0.05), NX)
    return g.select("dataset", "ix", "iy", "iz", *[rnd(a).alias(a) for a in "xyz"])


@query("J11_step_grid",
       f"""SELECT dataset, count(*) AS n, {R('sum(xl - 2.5 + i * 2.5)', 4)} AS sx, {R('max(zl - 2.5 + k * 2.5)')} AS z_max FROM (SELECT dataset, min(x) AS xl, max(x) - min(x) AS xw, max(y) - min(y) AS yw, min(z) AS zl, max(z) - min(z) AS zw FROM ({GRID}) g GROUP BY 1) b, range(12) a(i), range(8) bb(j), range(12) c(k)
 WHERE i * 2.5 <= xw + 5 + 1e-9 AND j * 2.5 <= yw + 5 + 1e-9 AND k * 2.5 <= zw + 5 + 1e-9 GROUP BY 1""")
def step_grid(spark, d):
    g = GR.step_grid(FL.bounding_box(view(spark, d, S.GRID), KEY), 2.5, 2.5)
    return g.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("x"), 4).alias("sx"), rnd(F.max("z")).alias("z_max"))


QPTS = "SELECT l_suppkey AS dataset, l_orderkey * 8 + l_linenumber AS qid, CAST(min(year(l_shipdate)) - 1995 AS INT) AS t_idx, min(l_quantity) / 2 - 2.3E0 AS x, min(l_discount) * 100 - 1.1E0 AS y, min(l_tax) * 200 + 0.7E0 AS z FROM {lineitem} GROUP BY l_suppkey, l_orderkey * 8 + l_linenumber"
MASKS = f"SELECT dataset, ix, iy, iz, t_c >= 100 AS occ, t_idx FROM ({S.GRID}) g"


@query("J10_nearest_mask_sampling", f"""SELECT p.qid, p.dataset, coalesce(p.ux BETWEEN 0 AND p.nx - 1 AND p.uy BETWEEN 0 AND p.ny - 1 AND p.uz BETWEEN 0 AND p.nz - 1 AND m.occ, false) AS inside FROM {located_sql(sub(QPTS))} p LEFT JOIN ({sub(MASKS)}) m ON m.dataset = p.dataset AND m.t_idx = p.t_idx AND m.ix = floor(p.ux + 0.5) AND m.iy = floor(p.uy + 0.5) AND m.iz = floor(p.uz + 0.5)""")
def nearest_mask(spark, d):
    return GR.sample_mask(view(spark, d, QPTS), view(spark, d, MASKS), shape_at(spark, d), [*KEY, "t_idx"]).select("qid", "dataset", "inside")


@query("J10_linear_distance_sampling", f"""SELECT p.qid, p.dataset, {R('CASE WHEN p.ux BETWEEN 0 AND p.nx - 1 AND p.uy BETWEEN 0 AND p.ny - 1 AND p.uz BETWEEN 0 AND p.nz - 1 THEN coalesce(v, 1e6) ELSE 1e6 END')} AS distance FROM {located_sql(sub(QPTS))} p LEFT JOIN {trilinear_sql(sub(QPTS), 'p.qid, p.dataset', f"SELECT dataset, ix, iy, iz, t_idx, t_min, t_c - 100 AS t_c FROM ({GRID}) g0", "AND s.t_idx = p.t_idx")} t ON t.qid = p.qid AND t.dataset = p.dataset""")
def linear_distance(spark, d):
    sdf, keys = view(spark, d, S.GRID).withColumn("sdf", F.col("t_c") - 100), [*KEY, "t_idx"]
    return GR.sample_distance(view(spark, d, QPTS), GR.halo_tiles(sdf, keys, "sdf"), shape_at(spark, d), keys).select("qid", "dataset", rnd("distance").alias("distance"))


@query("C6_resampled_field", f"SELECT dataset, ix, iy, iz, t_idx, {R('v')} AS t_c FROM {trilinear_sql(TARGET, 'p.dataset, p.ix, p.iy, p.iz', f'SELECT * FROM (SELECT *, count(t_c) OVER (PARTITION BY dataset, t_idx) AS nn FROM ({GRID}) g0) g1 WHERE nn >= 4')} t")
def resampled(spark, d):
    return GR.resample(view(spark, d, S.GRID), KEY, NX).where("t_c IS NOT NULL").select("dataset", "ix", "iy", "iz", "t_idx", rnd("t_c").alias("t_c"))


CLOUD = sub(S.CLOUD)
_CTARGET = TARGET.replace(f"({GRID})", f"(SELECT * FROM ({CLOUD}) c0 WHERE t_c IS NOT NULL)")
_NEAR = f"""(SELECT t.dataset, i.t_idx, t.ix, t.iy, t.iz, c.t_c, c.d, row_number() OVER (PARTITION BY t.dataset, i.t_idx, t.ix, t.iy, t.iz ORDER BY c.d, c.point_id) AS rn
 FROM ({_CTARGET}) t JOIN (SELECT dataset, t_idx FROM cloud GROUP BY 1, 2 HAVING count(*) >= 4) i USING (dataset), LATERAL (SELECT t_c, point_id, sqrt((t.x - q.x) * (t.x - q.x) + (t.y - q.y) * (t.y - q.y) + (t.z - q.z) * (t.z - q.z)) AS d FROM cloud q WHERE q.dataset = t.dataset AND q.t_idx = i.t_idx) c)"""


@query("C6_scattered_cloud", f"""WITH cloud AS MATERIALIZED (SELECT * FROM ({CLOUD}) c0 WHERE t_c IS NOT NULL)
SELECT dataset, t_idx, ix, iy, iz, {R('coalesce(avg(t_c) FILTER (d <= 1e-9), sum(t_c / (d * d)) FILTER (d > 1e-9) / sum(1 / (d * d)) FILTER (d > 1e-9))')} AS t_c FROM {_NEAR} n WHERE rn <= 8 GROUP BY 1, 2, 3, 4, 5""")
def scattered_cloud(spark, d):
    return GR.resample_scattered(view(spark, d, S.CLOUD), KEY, "point_id", NX).select("dataset", "t_idx", "ix", "iy", "iz", rnd("t_c").alias("t_c"))


# Every row with its dataset's last instant, its rank from there, and the voxel's value at it.
_TRAIL = f"""(SELECT *, t_min - t_end AS tau, max(CASE WHEN t_min = t_end THEN t_c END) OVER (PARTITION BY dataset, ix, iy, iz) AS a FROM
 (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY t_min DESC) AS r, max(t_min) OVER (PARTITION BY dataset) AS t_end FROM ({GRID}) g) q)"""
# Windows of voxels: only complete ones carry values on.
_WIN = f"""(SELECT *, CASE WHEN count(t_c) OVER w = least(12, max(instants) OVER w) THEN a END AS full_a FROM (SELECT t.*, instants FROM {_TRAIL} t JOIN (SELECT dataset, count(DISTINCT t_min) AS instants FROM ({GRID}) g GROUP BY 1) n USING (dataset) WHERE r <= 12) q
 WINDOW w AS (PARTITION BY dataset, ix, iy, iz))"""


@query("W12_trailing_window", f"SELECT dataset, ix, iy, iz, t_idx, {R('tau')} AS tau, {R('a')} AS a FROM {_TRAIL} t WHERE r <= 5")
def trailing(spark, d):
    return GR.trailing(view(spark, d, S.GRID), KEY, 5).select("dataset", "ix", "iy", "iz", "t_idx", rnd("tau").alias("tau"), rnd("a").alias("a"))


_LIN = f"""(SELECT dataset, ix, iy, iz, t_end, max(full_a) AS a, max(b) AS b, max(sxx) AS sxx, sqrt(avg(pow(t_c - full_a - b * tau, 2))) AS rmse FROM (SELECT *, sum((t_c - full_a) * tau) OVER w / nullif(sum(tau * tau) OVER w, 0) AS b, sum(tau * tau) OVER w AS sxx FROM {_WIN} t WINDOW w AS (PARTITION BY dataset, ix, iy, iz)) q GROUP BY 1, 2, 3, 4, 5)"""
_LINX = f"(SELECT dataset, ix, iy, iz, CAST(m AS DOUBLE) AS t_min, a + b * (m - t_end) AS t_c, CASE WHEN b IS NOT NULL THEN rmse * sqrt(1 + (m - t_end) * (m - t_end) / sxx) END AS sigma FROM {_LIN} l, range(1, 10) r(m) WHERE m > t_end)"


@query("A14_linear_trend", f"SELECT dataset, ix, iy, iz, t_min, {R('t_c')} AS t_c, {R('sigma')} AS sigma FROM {_LINX} t")
def linear_trend(spark, d):
    return GR.linear_trend(view(spark, d, S.GRID), KEY, 9.0).select("dataset", "ix", "iy", "iz", "t_min", rnd("t_c").alias("t_c"), rnd("sigma").alias("sigma"))


_PW = "OVER (PARTITION BY dataset, ix, iy, iz)"
_Q0 = f"(SELECT * EXCLUDE (a), full_a AS a, pow(1 - pow(abs(tau / span), 3), 3) AS w FROM (SELECT *, -min(tau) OVER (PARTITION BY dataset) AS span FROM {_WIN} t) q)"
_Q1 = f"(SELECT *, {', '.join(f'sum(w * pow(tau, {p})) {_PW}' + (' + 1e-8' if p in (0, 4) else '') + f' AS s{p}' for p in range(5))}, {', '.join(f'sum(w * pow(tau, {p}) * t_c) {_PW} AS r{p}' for p in range(3))} FROM {_Q0} q0)"
_Q2 = f"""(SELECT *, s0 * (m * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - m * s2) AS det FROM (SELECT *, s2 + 1e-8 AS m FROM {_Q1} q1) q2)"""
_Q3 = f"(SELECT *, (s0 * (r1 * s4 - s3 * r2) - r0 * (s1 * s4 - s3 * s2) + s2 * (s1 * r2 - r1 * s2)) / det AS b, (s0 * (m * r2 - r1 * s3) - s1 * (s1 * r2 - r1 * s2) + r0 * (s1 * s3 - m * s2)) / det AS c FROM {_Q2} q3)"
_QUAD = f"(SELECT dataset, ix, iy, iz, t_end, a, max(b) AS b, max(c) AS c, max(span) AS span, sqrt(sum(w * pow(t_c - a - b * tau - c * tau * tau, 2)) / sum(w)) AS rmse FROM {_Q3} q4 GROUP BY 1, 2, 3, 4, 5, 6)"


@query("A15_local_quadratic", f"SELECT dataset, ix, iy, iz, CAST(m AS DOUBLE) AS t_min, {R('a + b * (m - t_end) + c * (m - t_end) * (m - t_end)', 4)} AS t_c, {R('rmse * (1 + (m - t_end) / span)', 4)} AS sigma FROM {_QUAD} l, range(1, 10) r(m) WHERE m > t_end AND span > 0")
def local_quadratic(spark, d):
    return GR.local_quadratic(view(spark, d, S.GRID), KEY, 9.0).select("dataset", "ix", "iy", "iz", "t_min", rnd("t_c", 4).alias("t_c"), rnd("sigma", 4).alias("sigma"))


@query("A16_temporal_pca")
def temporal_pca(spark, d):
    return GR.pca_trend(view(spark, d, S.GRID), KEY, 9.0).select("dataset", "ix", "iy", "iz", "t_min", rnd("t_c", 4).alias("t_c"))


@query("A16_time_gram", f"""WITH c AS (SELECT dataset, ix, iy, iz, t_min, coalesce(t_c - avg(t_c) OVER (PARTITION BY dataset, ix, iy, iz), 0) AS v, dense_rank() OVER (PARTITION BY dataset ORDER BY t_min) - 1 AS k FROM ({GRID}) g)
SELECT a.dataset, CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j, {R('sum(a.v * b.v)', 4)} AS g FROM c a JOIN c b USING (dataset, ix, iy, iz) GROUP BY 1, 2, 3""")
def time_gram(spark, d):
    s = GR.centred(GR.voxel_series(view(spark, d, S.GRID), KEY))
    return GR.time_gram(s, KEY).select("dataset", "i", "j", rnd("g", 4).alias("g"))


@query("P28_segment_label", f"SELECT dataset, t_idx, CASE WHEN t_min > 4 + 1e-9 THEN 'extrapolado' ELSE 'fuente' END AS tramo FROM ({GRID}) g GROUP BY dataset, t_idx, t_min")
def segment_label(spark, d):
    return view(spark, d, S.GRID).select("dataset", "t_idx", GR.segment_label(F.col("t_min"), F.lit(4.0)).alias("tramo")).distinct()


@query("C7_volume_analysis_gradient", f"""SELECT dataset, method, t_min, {R('n * 1.5E0')} AS volume FROM (SELECT dataset, 'fuente' AS method, t_min, count(*) FILTER (t_c >= 100) AS n FROM ({GRID}) g GROUP BY 1, 3
UNION ALL SELECT dataset, 'gradiente_local', t_min, count(*) FILTER (t_c >= 100) FROM {_LINX} l GROUP BY 1, 3) u""")
def volume_gradient(spark, d):
    voxel = view(spark, d, S.GRID).select("dataset").distinct().withColumn("voxel", F.lit(1.5))
    _, curve = V4.analyse(view(spark, d, S.GRID), KEY, 9.0, voxel, 100.0)
    return curve.where("method IN ('fuente', 'gradiente_local')").select("dataset", "method", "t_min", rnd("volume").alias("volume"))


@query("C7_volume_analysis")
def volume_analysis(spark, d):
    box = FL.bounding_box(view(spark, d, S.GRID), KEY, 0.05)
    voxel = GR.voxel_volume(box, (3, 2, 3)).select("dataset", "voxel")
    _, curve = V4.analyse(view(spark, d, S.GRID), KEY, 9.0, voxel)
    return curve.select("dataset", "method", "t_min", rnd("sigma", 3).alias("sigma"), rnd("volume", 3).alias("volume"))


def _full_analysis() -> str:
    """Resampled field, line and quadratic beyond it, all of it corrected, as volumes."""
    from .field_queries import _FAC
    res = f"(SELECT dataset, ix, iy, iz, t_idx, t_min, v AS t_c FROM {trilinear_sql(TARGET, 'p.dataset, p.ix, p.iy, p.iz', f'SELECT * FROM (SELECT *, count(t_c) OVER (PARTITION BY dataset, t_idx) AS nn FROM ({GRID}) g0) g1 WHERE nn >= 4')} t)"
    on = lambda text: text.replace(f"({GRID})", "res")
    quad = f"(SELECT dataset, ix, iy, iz, CAST(m AS DOUBLE) AS t_min, a + b * (m - t_end) + c * (m - t_end) * (m - t_end) AS t_c, rmse * (1 + (m - t_end) / span) AS sigma FROM {on(_QUAD)} l, range(1, 10) r(m) WHERE m > t_end AND span > 0)"
    return f"""WITH res AS MATERIALIZED (SELECT * FROM {res} r0), ext AS (SELECT dataset, 'fuente' AS method, ix, iy, iz, t_min, t_c, CAST(NULL AS DOUBLE) AS sigma FROM res
 UNION ALL SELECT dataset, 'gradiente_local', ix, iy, iz, t_min, t_c, sigma FROM {on(_LINX)} l UNION ALL SELECT dataset, 'lowess_cuadratico', ix, iy, iz, t_min, t_c, sigma FROM {quad} q),
 b AS (SELECT r.* FROM res r JOIN (SELECT dataset, min(t_min) AS t_min FROM res GROUP BY 1) f USING (dataset, t_min)), pl AS (SELECT dataset, ix, iy, iz, z, {_ZN} AS zn FROM ({TARGET}) t0),
 vol AS (SELECT dataset, {' * '.join(f'({a}_hi - {a}_lo) / {m - 1}' for a, m in zip('xyz', NX))} AS voxel FROM (SELECT dataset, {_BOX} FROM ({GRID}) g GROUP BY 1) bx),
 c AS (SELECT e.*, s.s_nationkey AS corr_id, zo.exp_max, CASE WHEN e.t_min >= 1 - 1e-9 THEN b.t_c + zo.offset_c + fa.f * (e.t_c - b.t_c) ELSE e.t_c END AS moved FROM ext e JOIN pl USING (dataset, ix, iy, iz) LEFT JOIN b USING (dataset, ix, iy, iz)
 JOIN supplier s ON s.s_suppkey = e.dataset JOIN ({sub(S.ZONES)}) zo ON zo.corr_id = s.s_nationkey AND zo.zone_id = pl.zn JOIN {_FAC} fa ON fa.corr_id = s.s_nationkey AND fa.zone_id = pl.zn AND fa.t = least(e.t_min - 1, 4.4))
SELECT c.dataset, CAST(corr_id AS BIGINT) AS corr_id, method, t_min, {R('avg(sigma)', 4)} AS sigma, {R('count(*) FILTER (t_c >= 80) * max(voxel)')} AS volume, {R('count(*) FILTER (moved IS NOT NULL AND least(moved, 120, exp_max) >= 80) * max(voxel)')} AS volume_corr FROM c JOIN vol USING (dataset) GROUP BY 1, 2, 3, 4"""


def full_curves(spark, d):
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dataset"), F.col("s_nationkey").cast("long").alias("corr_id"))
    _, curve = V4.from_field(view(spark, d, S.GRID), KEY, 9.0, NX, 80.0, (pairs, view(spark, d, S.ZONES), view(spark, d, S.KNOTS)))
    return curve.select("dataset", "corr_id", "method", "t_min", rnd("sigma", 4).alias("sigma"), rnd("volume").alias("volume"), rnd("volume_corr").alias("volume_corr"))


@query("C7_full_analysis")
def full_analysis(spark, d):
    return full_curves(spark, d)


@query("C8_method_choice", f"SELECT dataset, ix, iy, iz, t_min, {R('t_c')} AS t_shown FROM {_LINX} t")
def method_choice(spark, d):
    x = GR.chosen_method(GR.extrapolations(view(spark, d, S.GRID), KEY, 9.0), "Gradiente local").withColumn("t_corr", F.lit(None).cast("double"))
    return GR.chosen_field(x).select("dataset", "ix", "iy", "iz", "t_min", rnd("t_shown").alias("t_shown"))


_ZN = "CASE WHEN z < 21.9 THEN 1 WHEN z < 28.5 THEN 2 WHEN z < 35.1 THEN 3 ELSE 4 END"


@query("C7_full_analysis_trends", _full_analysis())
def full_trends(spark, d):
    return full_curves(spark, d).where("method != 'pca_temporal'")


def _reapplied() -> str:
    from .field_queries import _FAC
    return f"""SELECT g.dataset, ix, iy, iz, g.t_min, {R("least(CASE WHEN g.t_min >= 1 - 1e-9 THEN b + zo.offset_c + fa.f * (t_c - b) ELSE t_c END, 120, zo.exp_max)")} AS t_corr FROM (SELECT *, first_value(t_c) OVER (PARTITION BY dataset, ix, iy, iz ORDER BY t_min) AS b, {_ZN} AS zn FROM ({GRID}) g0) g
 JOIN supplier s ON s.s_suppkey = g.dataset JOIN ({sub(S.ZONES)}) zo ON zo.corr_id = s.s_nationkey AND zo.zone_id = g.zn JOIN {_FAC} fa ON fa.corr_id = s.s_nationkey AND fa.zone_id = g.zn AND fa.t = least(g.t_min - 1, 4.4)"""


@query("C9_reapplied_correction", _reapplied())
def reapplied(spark, d):
    full = view(spark, d, S.GRID).withColumn("method", F.lit(V4.ORIGINAL))
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dataset"), F.col("s_nationkey").cast("long").alias("corr_id"))
    out = V4.apply_correction(full, KEY, pairs, view(spark, d, S.ZONES), view(spark, d, S.KNOTS))
    return out.select("dataset", "ix", "iy", "iz", "t_min", rnd("t_corr").alias("t_corr"))


@query("C10_plane_slices", f"""SELECT dataset, 'xy' AS plane, ix, iy, iz, t_c FROM ({GRID}) g WHERE t_idx = 2 AND iz = 1 UNION ALL SELECT dataset, 'xz', ix, iy, iz, t_c FROM ({GRID}) g WHERE t_idx = 2 AND iy = 0 UNION ALL SELECT dataset, 'yz', ix, iy, iz, t_c FROM ({GRID}) g WHERE t_idx = 2 AND ix = 1""")
def plane_slices(spark, d):
    return GR.plane_slices(view(spark, d, S.GRID), shape(spark, d), KEY, 2)


QT = f"SELECT dataset, qid, x, y, z, 0.31E0 + qid % 7 AS t FROM ({QPTS}) q"
_LO = "least(CAST(floor(t) AS INT), 5)"


@query("C11_field_evaluation", f"""SELECT a.qid, a.dataset, {R('a.v * (1 - (q.t - a.t_idx)) + b.v * (q.t - a.t_idx)')} AS t_eval FROM ({sub(QT)}) q JOIN {trilinear_sql(sub(QT), 'p.qid, p.dataset')} a ON a.qid = q.qid AND a.dataset = q.dataset AND a.t_idx = least(CAST(floor(q.t) AS INT), 5) JOIN {trilinear_sql(sub(QT), 'p.qid, p.dataset')} b ON b.qid = q.qid AND b.dataset = q.dataset AND b.t_idx = a.t_idx + 1""")
def field_evaluation(spark, d):
    return GR.evaluate(view(spark, d, S.GRID), view(spark, d, QT), shape(spark, d), KEY, ["qid"]).where("t_eval IS NOT NULL").select("qid", "dataset", rnd("t_eval").alias("t_eval"))


@query("A22_largest_radius", f"SELECT {R('max(greatest(abs(x0), abs(x0 + dx * (nx - 1)), abs(y0), abs(y0 + dy * (ny - 1)), abs(z0), abs(z0 + dz * (nz - 1)))) + 5')} AS radius_max FROM ({SHAPE}) s")
def largest_radius(spark, d):
    return GR.largest_extent(shape(spark, d)).withColumn("radius_max", rnd("radius_max"))
