"""Completeness and consistency checks with their first failing reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.operators import validate as V

from . import standins as S
from .core import R, query, rnd, sub, table, view
from .metadata_queries import CAT

FIELD = sub(S.FIELD)
CONFIG = {"n_grid": 60, "t_abl": 55.0, "t_carbon": 300.0, "enabled": True, "z_min_mm": 0.0, "z_max_mm": 45.0, "radius_mm": 50.0}

# Dataset metadata by supplier; every point of the field is a probe, and those of every tenth dataset are filed under the next one.
META = """SELECT s_suppkey AS sid, CAST(7 - s_suppkey % 3 % 2 AS BIGINT) AS n_t, CAST(7 - s_suppkey % 3 % 2 - CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_snap,
 CAST(7 - s_suppkey % 3 % 2 - CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_fin, s_suppkey % 5 > 0 AS full_field_available, CAST(60 - s_suppkey % 7 % 2 * 5 AS INT) AS n_grid,
 55.0E0 + s_suppkey % 9 % 2 AS t_abl, 300.0E0 AS t_carbon, true AS dom_enabled, 0.0E0 AS dom_z0, 45.0E0 AS dom_z1, CASE WHEN s_suppkey % 4 = 3 THEN 40.0E0 ELSE 50.0E0 END AS dom_r FROM {supplier}"""
PROBE = f"""SELECT CASE WHEN sid % 10 = 0 THEN sid + 1 ELSE sid END AS sid, concat('S', CAST(point_id AS STRING)) AS probe, t_idx, t_min, t_c FROM ({S.FIELD}) f"""

_FS = f"""(SELECT sid, count(*) AS ff_instants, min(n) AS ff_min, max(n) AS ff_max, CAST(sum(v) AS BIGINT) AS ff_values FROM (SELECT sid, t_idx, count(*) AS n, count(t_c) AS v FROM ({FIELD}) f GROUP BY 1, 2) p GROUP BY 1)"""
_FR = """CASE WHEN ff_instants IS NULL OR ff_max = 0 THEN 'full_field vacio' WHEN ff_min <> ff_max OR ff_instants <> n_t THEN 'full_field no coincide con puntos/tiempos' WHEN ff_values = 0 THEN 'full_field sin temperaturas finitas' END"""
_PS = f"""(SELECT p.sid, count(*) AS n_probes, count(*) FILTER (n <> n_t OR t <> n_t) AS probes_wrong, count(*) FILTER (n = n_t AND t = n_t AND v < n) AS probes_gaps
 FROM (SELECT sid, probe, count(*) AS n, count(t_c) AS v, count(t_min) AS t FROM ({sub(PROBE)}) q GROUP BY 1, 2) p JOIN ({sub(META)}) m USING (sid) GROUP BY 1)"""
_PR = """CASE WHEN coalesce(n_probes, 0) = 0 THEN 'sin sondas extraidas' WHEN probes_wrong > 0 THEN 'sonda no coincide con tiempos' WHEN probes_gaps > 0 THEN 'sonda contiene NaN/Inf' END"""
_DOM = "NOT (dom_enabled AND abs(dom_z0 - 0) <= 1e-9 AND abs(dom_z1 - 45) <= 1e-9 AND abs(dom_r - 50) <= 1e-9)"
_CR = f"""CASE WHEN NOT full_field_available THEN 'metadata sin full_field disponible' WHEN n_grid <> 60 THEN 'resolucion de grilla distinta a la configuracion actual' WHEN abs(t_abl - 55) > 1e-9 THEN 'umbral de ablacion distinto a la configuracion actual'
 WHEN abs(t_carbon - 300) > 1e-9 THEN 'umbral de carbonizacion distinto a la configuracion actual' WHEN {_DOM} THEN 'dominio de extraccion distinto a la configuracion actual' END"""
_RR = f"""coalesce(CASE WHEN n_t = 0 OR n_fin <> n_t THEN 'vector temporal invalido' WHEN n_snap <> n_t THEN 'numero de snapshots distinto al vector temporal' END, {_FR}, {_PR}, {_CR})"""
_ALL = f"(SELECT * FROM ({sub(META)}) m LEFT JOIN {_FS} f USING (sid) LEFT JOIN {_PS} p USING (sid))"


def _joined(spark, d, field_filter=None):
    m = view(spark, d, META)
    f = V.field_summary(view(spark, d, S.FIELD), ["sid"])
    p = V.probe_summary(view(spark, d, PROBE), m.select("sid", "n_t"), ["sid"])
    return m.join(f, "sid", "left").join(p, "sid", "left")


@query("V1c_record_completeness", f"SELECT sid, {_RR} AS motivo FROM {_ALL} t")
def record_completeness(spark, d):
    return _joined(spark, d).select("sid", V.record_reason(F.col("n_t"), F.col("n_fin"), F.col("n_snap"), CONFIG).alias("motivo"))


# A field whose instants mostly have all points: one row per supplier, half and year.
DENSE = "SELECT l_suppkey AS sid, CAST(year(l_shipdate) - 1995 AS INT) AS t_idx, l_linenumber AS point_id, CASE WHEN l_suppkey % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE max(l_extendedprice) END AS t_c FROM {lineitem} GROUP BY 1, 2, 3"


@query("V2c_field_completeness", f"""SELECT m.sid, {_FR} AS motivo, ff_min, ff_max FROM (SELECT sid, CASE WHEN sid % 5 = 0 THEN 8 ELSE 7 END AS n_t FROM ({sub(META)}) q) m LEFT JOIN
 (SELECT sid, count(*) AS ff_instants, min(n) AS ff_min, max(n) AS ff_max, sum(v) AS ff_values FROM (SELECT sid, t_idx, count(*) AS n, count(t_c) AS v FROM ({sub(DENSE)}) f GROUP BY 1, 2) p GROUP BY 1) f USING (sid)""")
def field_completeness(spark, d):
    m = view(spark, d, META).select("sid", F.when(F.col("sid") % 5 == 0, 8).otherwise(7).alias("n_t"))
    return m.join(V.field_summary(view(spark, d, DENSE), ["sid"]), "sid", "left").select("sid", V.field_reason(F.col("n_t")).alias("motivo"), "ff_min", "ff_max")


@query("V3c_probe_completeness", f"SELECT sid, {_PR} AS motivo, n_probes, probes_wrong, probes_gaps FROM {_ALL} t")
def probe_completeness(spark, d):
    return _joined(spark, d).select("sid", V.probe_reason().alias("motivo"), "n_probes", "probes_wrong", "probes_gaps")


@query("V4c_config_compatibility", f"SELECT sid, {_CR} AS motivo, {_DOM} AS dominio FROM ({sub(META)}) m")
def config_compatibility(spark, d):
    dom = V.domain_differs(F.col("dom_enabled"), F.col("dom_z0"), F.col("dom_z1"), F.col("dom_r"), CONFIG)
    return view(spark, d, META).select("sid", V.config_reason(CONFIG).alias("motivo"), dom.alias("dominio"))


SHIFT = """SELECT s_suppkey AS sid, concat('m_', CAST(s_suppkey % 2 + 1 AS STRING), 'ant.mph') AS model_path, CASE WHEN s_suppkey % 14 = 0 THEN CAST(NULL AS BOOLEAN) ELSE s_suppkey % 10 > 0 END AS shift_applied,
 CASE WHEN s_suppkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE 1.0E0 END AS shift_x, 1.0E0 AS shift_y FROM {supplier}"""
SPROBE = """SELECT l_suppkey AS sid, concat('S', CAST(l_linenumber AS STRING)) AS probe, CASE WHEN l_suppkey % 26 = 2 AND l_linenumber = 3 THEN 2.0E0 ELSE 1.0E0 END AS x, 1.0E0 AS y,
 NOT (l_suppkey % 22 = 4 AND l_linenumber = 5) AS in_domain, count(*) AS n, count(*) - CASE WHEN l_suppkey % 18 = 6 AND l_linenumber = 1 THEN 1 ELSE 0 END AS n_finite FROM {lineitem} GROUP BY l_suppkey, l_linenumber"""


@query("V5c_single_antenna_checks", f"""SELECT sid, CASE WHEN shift_applied IS NULL THEN 'metadata sin desfase_1antena' WHEN NOT shift_applied THEN 'desfase_1antena no aplicado' WHEN NOT placed THEN 'probe_points fuera de la posicion esperada'
 WHEN NOT inside THEN 'sonda marcada fuera de dominio' WHEN NOT whole THEN 'sonda contiene NaN/Inf' END AS reason
FROM ({sub(SHIFT)}) m LEFT JOIN (SELECT p.sid, bool_and(abs(x - coalesce(shift_x, 1)) <= 1e-9 AND abs(y - shift_y) <= 1e-9) AS placed, bool_and(in_domain) AS inside, bool_and(n > 0 AND n = n_finite) AS whole FROM ({sub(SPROBE)}) p JOIN ({sub(SHIFT)}) q USING (sid) GROUP BY 1) g USING (sid) WHERE contains(model_path, '1ant')""")
def single_antenna_checks(spark, d):
    return V.single_antenna_reason(view(spark, d, SPROBE), view(spark, d, SHIFT), ["sid"])


SIGN = "SELECT s_suppkey AS modelo, CAST(s_acctbal * 100 AS BIGINT) AS bytes, 739000 + s_acctbal AS mtime_days FROM {supplier}"
OLD = f"SELECT modelo, bytes + CASE WHEN modelo % 7 = 0 THEN 1 ELSE 0 END AS bytes, mtime_days + CASE WHEN modelo % 5 = 0 THEN 1.0E-6 ELSE 0.0E0 END AS mtime_days FROM ({SIGN}) s WHERE modelo % 11 > 0"


@query("V6c_source_changed", f"""SELECT s.modelo, CASE WHEN o.bytes IS NULL THEN 'modelo existente sin firma de archivo' WHEN o.bytes <> s.bytes OR abs(o.mtime_days - s.mtime_days) > 1e-7 THEN 'archivo cambiado' END AS reason FROM ({sub(SIGN)}) s LEFT JOIN ({sub(OLD)}) o USING (modelo)""")
def source_changed(spark, d):
    return V.source_reason(view(spark, d, OLD), view(spark, d, SIGN))


@query("V7c_reextraction_decision", f"""SELECT t.sid, coalesce(CASE WHEN o.bytes IS NULL THEN 'modelo existente sin firma de archivo' WHEN o.bytes <> s.bytes OR abs(o.mtime_days - s.mtime_days) > 1e-7 THEN 'archivo cambiado' END, {_RR}) AS motivo
FROM {_ALL} t JOIN ({sub(SIGN)}) s ON s.modelo = t.sid LEFT JOIN ({sub(OLD)}) o ON o.modelo = t.sid""")
def reextraction(spark, d):
    src = V.source_reason(view(spark, d, OLD), view(spark, d, SIGN)).select(F.col("modelo").alias("sid"), "reason")
    j = _joined(spark, d).join(src, "sid")
    return j.select("sid", V.reextract(F.col("reason"), V.record_reason(F.col("n_t"), F.col("n_fin"), F.col("n_snap"), CONFIG)).alias("motivo"))


@query("V8c_tmax_consistency", f"""SELECT sid, count(abs(t_max_c - t_max_meta)) AS n_pairs, count(*) FILTER (abs(t_max_c - t_max_meta) > 1e-6) AS n_diff, {R('max(abs(t_max_c - t_max_meta))')} AS max_diff FROM ({sub(S.INSTANTS)}) i GROUP BY 1""")
def tmax_consistency(spark, d):
    from thermal_lake.operators import field as FL
    return FL.tmax_consistency(view(spark, d, S.INSTANTS), ["sid"]).withColumn("max_diff", rnd("max_diff"))


@query("V9c_correction_compatibility", f"""SELECT seq, concat_ws(', ', CASE WHEN NOT coalesce(lower(r.tipo) = lower(c.tipo), false) THEN 'tipo' END, CASE WHEN NOT coalesce(lower(r.antena) = lower(c.antena), false) THEN 'antena' END,
 CASE WHEN NOT coalesce(abs(r.caso - c.caso) <= 1e-9, false) THEN 'caso' END, CASE WHEN NOT coalesce(abs(r.potencia_w - c.potencia_w) <= 1e-9, false) THEN 'potencia_w' END) AS distintos FROM ({CAT}) c JOIN ({sub(S.CORRECTIONS)}) r ON r.corr_id = c.seq % 100""")
def correction_compatibility(spark, d):
    names = ("tipo", "antena", "caso", "potencia_w")
    r = view(spark, d, S.CORRECTIONS).select("corr_id", *[F.col(n).alias(f"r_{n}") for n in names])
    c = view(spark, d, S.CATALOG).withColumn("corr_id", F.col("seq") % 100).join(r, "corr_id")
    return c.select("seq", V.incompatible_fields({n: F.col(f"r_{n}") for n in names}, {n: F.col(n) for n in names}).alias("distintos"))
