"""Pixels: colour features and rules, clusters, components, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.functions import colour as CL
from thermal_lake.operators import pixels as PX
from thermal_lake.operators import voxel as VX

from . import standins as S
from .core import R, query, rnd, table, view

PIX = S.PIXEL_DUCK


def pixels(spark, d):
    return view(spark, d, S.PIXEL_SPARK)


_LIN = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"
_XYZ = f"""SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS tx, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS ty, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS tz
 FROM (SELECT *, CAST({_LIN('r')} AS DOUBLE) AS lr, CAST({_LIN('g')} AS DOUBLE) AS lg, CAST({_LIN('b')} AS DOUBLE) AS lb, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM ({PIX}) p0) p1"""
_F = lambda c: f"CASE WHEN {c} > 216.0E0 / 24389 THEN cbrt({c}) ELSE ({c} * (24389.0E0 / 27) + 16) / 116 END"
_HUE = "CASE WHEN mx = mn THEN 0.0E0 WHEN mx = r THEN CASE WHEN g < b THEN (g - b) / (mx - mn) / 6 + 1 ELSE (g - b) / (mx - mn) / 6 END WHEN mx = g THEN (2 + (b - r) / (mx - mn)) / 6 ELSE (4 + (r - g) / (mx - mn)) / 6 END"
FEAT = f"SELECT image_id, row, col, r, g, b, 116 * fy - 16 AS lab_l, 500 * (fx - fy) AS lab_a, 200 * (fy - fz) AS lab_b, 100 * ({_HUE}) AS hue, CASE WHEN mx = 0 THEN 0 ELSE 100 * (mx - mn) / mx END AS sat, 100 * mx AS val FROM (SELECT *, {_F('tx')} AS fx, {_F('ty')} AS fy, {_F('tz')} AS fz FROM ({_XYZ}) x0) x1"


@query("P26_colour_features", f"""SELECT image_id, row, col, {', '.join(f"{R(f'coalesce(({c} - avg({c}) OVER (PARTITION BY image_id)) / nullif(stddev_samp({c}) OVER (PARTITION BY image_id), 0), 0)')} AS {c}" for c in CL.FEATURES)} FROM ({FEAT}) f""")
def colour_features(spark, d):
    z = CL.zscore_features(CL.with_colour_features(pixels(spark, d)))
    return z.select("image_id", "row", "col", *[rnd(c).alias(c) for c in CL.FEATURES])


_BR = "hue > 2.5 AND hue < 18 AND sat > 7 AND sat < 60 AND val > 18 AND val < 92 AND r > g * 0.8 AND r < g * 1.65 AND g >= b * 0.65"
_CH = "val < 32 AND lab_l < 36 AND sat > 6 AND r < 0.42 AND g < 0.42 AND b < 0.42"


def rules(spark, d):
    p = CL.with_colour_features(pixels(spark, d))
    h, s, v = F.col("hue") / 100, F.col("sat") / 100, F.col("val") / 100
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.withColumns({"brown": CL.brown(h, s, v, r, g, b), "charred": CL.charred(F.col("lab_l"), s, v, r, g, b)})


@query("P27_ablation_colour_rules", f"SELECT image_id, row, col, {_BR} AS brown, {_CH} AS charred FROM ({FEAT}) f")
def colour_rules(spark, d):
    return rules(spark, d).select("image_id", "row", "col", "brown", "charred")


_CLU = f"(SELECT *, (row * 3 + col * 5) % 4 AS cluster, row <= 1 OR row > 7 OR col <= 1 OR col > 7 AS border FROM ({FEAT}) f)"


@query("A25_cluster_profile", f"""WITH p AS (SELECT image_id, cluster, count(*) AS n, count(*) FILTER (border) AS n_border, avg(sat / 100) AS ms, avg(val / 100) AS mv, avg(lab_a) AS ma, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM {_CLU} c GROUP BY 1, 2), b AS (SELECT *, first_value(cluster) OVER (PARTITION BY image_id ORDER BY n_border DESC, cluster) AS background, n_border / n AS share FROM p)
SELECT image_id, cluster, background, {R('share')} AS border_share, {R('ms')} AS mean_s, {R('ma')} AS mean_a, ((ms > 0.18 AND ma > 8 AND mr - greatest(mg, mb) > 0.03) OR (mv > 0.45 AND ms < 0.45 AND share < 0.45)) AND cluster <> background AND share < 0.55 AS object FROM b""")
def cluster_profile(spark, d):
    p = CL.with_colour_features(pixels(spark, d)).withColumns({
        "cluster": (F.col("row") * 3 + F.col("col") * 5) % 4, "border": (F.col("row") <= 1) | (F.col("row") > 7) | (F.col("col") <= 1) | (F.col("col") > 7),
        "sat": F.col("sat") / 100, "val": F.col("val") / 100})
    return PX.cluster_profile(p).select("image_id", "cluster", "background", rnd("border_share").alias("border_share"), rnd("mean_s").alias("mean_s"), rnd("mean_a").alias("mean_a"), "object")


_MASK = f"SELECT image_id, row, col, {_BR} AS brown, {_CH} AS charred FROM ({FEAT}) f WHERE r > 0.5"
# Components of an 8 x 8 image by growing the smallest position through the eight neighbours.
_COMP = f"""m AS MATERIALIZED (SELECT *, row * 8 + col AS p FROM ({_MASK}) k), e AS MATERIALIZED (SELECT a.image_id, a.p AS a, b.p AS b FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
 reach(image_id, a, b) AS (SELECT image_id, a, b FROM e UNION SELECT reach.image_id, reach.a, e.b FROM reach JOIN e ON e.image_id = reach.image_id AND e.a = reach.b), lab AS (SELECT image_id, a AS p, min(b) AS root FROM reach GROUP BY 1, 2),
 area AS (SELECT image_id, root, count(*) AS area FROM lab GROUP BY 1, 2)"""


def labelled(spark, d):
    m = rules(spark, d).where("r > 0.5").select("image_id", F.col("row").alias("ix"), F.col("col").alias("iy"), F.lit(0).alias("iz"), "brown", "charred")
    return VX.components(m, ["image_id"], 8).join(m, ["image_id", "ix", "iy", "iz"])


@query("C30_largest_component", f"WITH RECURSIVE {_COMP}, best AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, root) AS rn FROM area WHERE area >= 3) SELECT m.image_id, m.row, m.col, b.area FROM best b JOIN lab USING (image_id, root) JOIN m ON m.image_id = lab.image_id AND m.p = lab.p WHERE rn = 1")
def largest_component(spark, d):
    return VX.largest_component(labelled(spark, d), ["image_id"], 3).select("image_id", F.col("ix").alias("row"), F.col("iy").alias("col"), "area")


@query("A26_component_score", f"""WITH RECURSIVE {_COMP}, s AS (SELECT m.image_id, root, count(*) + 1200 * avg(CASE WHEN brown THEN 1.0 ELSE 0 END) + 1200 * avg(CASE WHEN charred THEN 1.0 ELSE 0 END) - 3000 * sqrt((avg(col) - 4) ** 2 + (avg(row) - 4) ** 2) / 8 AS score, count(*) AS area FROM m JOIN lab ON m.image_id = lab.image_id AND m.p = lab.p GROUP BY 1, 2)
SELECT image_id, area, {R('score', 4)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 6) DESC, root) AS rn FROM s) t WHERE rn = 1""")
def component_score(spark, d):
    c = labelled(spark, d).select("image_id", "root", F.col("ix").alias("row"), F.col("iy").alias("col"), "brown", "charred")
    size = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(4.0).alias("ref_row"), F.lit(4.0).alias("ref_col"))
    s = PX.component_scores(c, size).withColumn("score", F.round("score", 6))
    return PX.best_component(s).select("image_id", "area", rnd("score", 4).alias("score"))


@query("C29_colour_clustering")
def colour_clustering(spark, d):
    z = CL.zscore_features(CL.with_colour_features(pixels(spark, d)))
    return PX.clusters(z, 3)


FACES = "SELECT o_custkey AS grp, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS face, 1.0E0 + o_orderkey % 4 AS thickness FROM {orders}"
_SEG = "(SELECT *, CAST(1 + sum(flag) OVER (PARTITION BY grp ORDER BY pos) AS INT) AS segment FROM (SELECT *, CASE WHEN lag(face) OVER w IS NOT NULL AND (face = 1 OR lag(face) OVER w = 2) THEN 1 ELSE 0 END AS flag FROM (SELECT o_custkey AS grp, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS face, 1.0E0 + o_orderkey % 4 AS thickness FROM orders) f WINDOW w AS (PARTITION BY grp ORDER BY pos)) q)"


@query("W10_segment_numbering", f"SELECT grp, pos, segment FROM {_SEG} s")
def segment_numbering(spark, d):
    return PX.numbered_segments(view(spark, d, FACES), ["grp"]).select("grp", "pos", "segment")


@query("W10_segment_numbering_blocks", f"SELECT grp, pos, segment FROM {_SEG} s")
def segment_numbering_blocks(spark, d):
    """The same with groups cut into blocks of five rows."""
    return PX.numbered_segments(view(spark, d, FACES), ["grp"], rows=5).select("grp", "pos", "segment")


@query("W11_slice_depth", f"""WITH s AS {_SEG}, t AS (SELECT grp, segment, min(thickness) AS th FROM s GROUP BY 1, 2), c AS (SELECT *, sum(th) OVER (PARTITION BY grp ORDER BY segment) AS e FROM t) SELECT s.grp, s.pos, {R('CASE WHEN face = 2 THEN e ELSE e - th END')} AS z_mm FROM s JOIN c USING (grp, segment)""")
def slice_depth(spark, d):
    s = PX.numbered_segments(view(spark, d, FACES), ["grp"])
    t = s.groupBy("grp", "segment").agg(F.min("thickness").alias("thickness"))
    return PX.slice_depth(s.drop("thickness"), t, ["grp"]).select("grp", "pos", rnd("z_mm").alias("z_mm"))


@query("C28_slice_cloud", f"""WITH p AS (SELECT image_id % 50 AS grp, image_id, row, col FROM ({PIX}) q WHERE r > 0.75), c AS (SELECT grp, col * 0.5 AS x, row * 0.5 AS y, 3.0 * floor(image_id / 50) AS z FROM p)
SELECT grp, count(*) AS n_points, count(DISTINCT z) AS n_slices, {R('sum(x)')} AS sx, {R('sum(y)')} AS sy, CASE WHEN count(*) < 10 THEN 'pocos_puntos' WHEN count(DISTINCT z) < 2 THEN 'un_solo_corte' ELSE 'ok' END AS status FROM c GROUP BY 1""")
def slice_cloud(spark, d):
    p = pixels(spark, d).where("r > 0.75").withColumn("grp", F.col("image_id") % 50).select("grp", "image_id", "row", "col")
    slices = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("grp"), F.col("vec_id").alias("image_id"), (3.0 * F.floor(F.col("vec_id") / 50)).alias("z_mm"))
    cloud = PX.slice_cloud(p, slices, 0.5, "grp")
    sums = cloud.groupBy("grp").agg(rnd(F.sum("x")).alias("sx"), rnd(F.sum("y")).alias("sy"))
    return PX.cloud_check(cloud, "grp").join(sums, "grp")
