"""Thermal tables derived from the driver's tables (SELECT text for both engines)."""

from __future__ import annotations

_KIND = ("CASE {0} % 3 WHEN 0 THEN 'Doble_slot' WHEN 1 THEN 'Monopolo' ELSE 'Un_slot' END")


def kind(key: str) -> str:
    return _KIND.replace("{0}", key)


# Point field: dataset = supplier, point = (quantity, discount, tax) cell, instant = ship year.
FIELD_RAW = """
SELECT l_suppkey AS sid,
       concat('modelo_', {K}, '_', CAST(l_suppkey % 4 + 1 AS STRING), 'ant') AS modelo,
       concat('dset_c', CAST(l_suppkey % 9 AS STRING), '_p', CAST(5 * (l_suppkey % 12 + 1) AS STRING), '_s', CAST(l_suppkey AS STRING)) AS dataset,
       CAST(ix * 18 + iy * 9 + iz AS BIGINT) AS point_id, ix, iy, iz,
       CAST(ix * 10 - 20 AS DOUBLE) AS x, CAST(iy * 20 - 10 AS DOUBLE) AS y, CAST(iz * 5 + 1 AS DOUBLE) AS z,
       t_idx, CAST(t_idx AS DOUBLE) AS t_min,
       CASE WHEN (l_suppkey * 7 + ix * 31 + iy * 11 + iz * 3 + t_idx) % 41 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 37 + top / 1000 END AS t_raw
FROM (SELECT l_suppkey, CAST(floor((l_quantity - 1) / 10) AS INT) AS ix, CASE WHEN l_discount >= 0.045 THEN 1 ELSE 0 END AS iy,
             CAST(floor(l_tax * 100 + 0.5) AS INT) AS iz, CAST(year(l_shipdate) - 1995 AS INT) AS t_idx, max(l_extendedprice) AS top
      FROM {lineitem} GROUP BY 1, 2, 3, 4, 5) cell
""".replace("{K}", kind("l_suppkey"))

# The same after the missing-value contract.
FIELD = f"""
SELECT sid, modelo, dataset, point_id, x, y, z, t_idx, t_min, CASE WHEN isnan(t_raw) THEN NULL ELSE t_raw END AS t_c
FROM ({FIELD_RAW}) raw
"""

INSTANTS = f"""
SELECT sid, modelo, dataset, t_idx, t_min, max(t_c) AS t_max_c,
       CASE WHEN (sid + t_idx) % 5 = 0 THEN max(t_c) + 0.5 WHEN (sid + t_idx) % 7 = 0 THEN NULL ELSE max(t_c) END AS t_max_meta
FROM ({FIELD}) f GROUP BY sid, modelo, dataset, t_idx, t_min
"""

# Regular grid 3 x 2 x 3 per supplier and year.
GRID = """
SELECT l_suppkey AS dataset, ix, iy, iz, CAST(ix * 10 AS DOUBLE) AS x, CAST(iy * 8 AS DOUBLE) AS y, CAST(iz * 6 + 2 AS DOUBLE) AS z,
       t_idx, CAST(t_idx AS DOUBLE) AS t_min, 37 + max(l_extendedprice) / 1000 AS t_c
FROM (SELECT l_suppkey, l_extendedprice, CAST(floor((l_quantity - 1) / 17) AS INT) AS ix, CASE WHEN l_discount >= 0.055 THEN 1 ELSE 0 END AS iy,
             CAST(floor(l_tax * 100 + 0.5) / 3 AS INT) AS iz_, CAST(floor(floor(l_tax * 100 + 0.5) / 3) AS INT) AS iz,
             CAST(year(l_shipdate) - 1995 AS INT) AS t_idx FROM {lineitem}) c
GROUP BY l_suppkey, ix, iy, iz, t_idx
""".replace("CAST(floor(l_tax * 100 + 0.5) / 3 AS INT) AS iz_, ", "")

# Scattered cloud: every order line is a point of its supplier's cloud in the year it was shipped; no two instants share their points.
CLOUD = """
SELECT l_suppkey AS dataset, l_orderkey * 8 + l_linenumber AS point_id, CAST(year(l_shipdate) - 1995 AS INT) AS t_idx, CAST(year(l_shipdate) - 1995 AS DOUBLE) AS t_min,
       min(l_quantity) * 2 - 50.3E0 + (l_orderkey % 13) * 0.1E0 AS x, min(l_discount) * 300 - 15.2E0 + (l_orderkey % 7) * 0.13E0 AS y,
       min(l_tax) * 200 + 1.1E0 + (l_orderkey % 5) * 0.17E0 AS z, CASE WHEN l_orderkey % 41 = 0 THEN CAST(NULL AS DOUBLE) ELSE 37 + min(l_extendedprice) / 1000 END AS t_c
FROM {lineitem} GROUP BY l_suppkey, l_orderkey, l_linenumber, year(l_shipdate)
"""

# Probe curves: run = four users, even events simulated, odd events measured.
CURVE = """
SELECT CAST(floor(user_id / 4) AS BIGINT) AS corr_id, CAST(user_id % 4 + 1 AS INT) AS probe_idx, event_id % 2 AS side, event_id AS seq,
       CAST(day(ts) * 1440 + hour(ts) * 60 + minute(ts) AS DOUBLE) AS t_min, value + 37.0 AS t_c
FROM {events}
"""

# Corrections by nation: four depth zones, five knots each.
ZONES = """
SELECT CAST(n_nationkey AS BIGINT) AS corr_id, z.zone_id, z.z_min, z.z_max, z.top, 1.0E0 AS t_origin,
       CAST(n_nationkey % 5 - 2 AS DOUBLE) AS offset_c, CAST(105 + n_nationkey % 20 AS DOUBLE) AS exp_max
FROM {nation} CROSS JOIN (VALUES (1, CAST(NULL AS DOUBLE), 21.9E0, false), (2, 21.9E0, 28.5E0, false), (3, 28.5E0, 35.1E0, false),
                            (4, 35.1E0, CAST(NULL AS DOUBLE), true)) AS z(zone_id, z_min, z_max, top)
"""
KNOTS = """
SELECT CAST(n_nationkey AS BIGINT) AS corr_id, z.zone_id, k.t,
       CAST(1 - (0.02E0 + 0.01E0 * z.zone_id) * k.t - 0.004E0 * ((n_nationkey + k.i * k.i) % 7) AS DOUBLE) AS f
FROM {nation} CROSS JOIN (VALUES (1), (2), (3), (4)) AS z(zone_id)
CROSS JOIN (VALUES (0, 0.0E0), (1, 0.9E0), (2, 1.7E0), (3, 3.2E0), (4, 4.4E0)) AS k(i, t)
"""
_NAMES = """concat('modelo_', {K}, '_', CAST({k} % 4 + 1 AS STRING), 'ant') AS modelo,
       concat('dset_c', CAST({k} % 9 AS STRING), '_p', CAST(5 * ({k} % 12 + 1) AS STRING), '_s', CAST({k} AS STRING)) AS dataset"""
PAIRS = f"SELECT {_NAMES.replace('{K}', kind('s_suppkey')).replace('{k}', 's_suppkey')}, CAST(s_nationkey AS BIGINT) AS corr_id FROM {{supplier}}"
# The dataset table's time vectors.
TIMES = f"SELECT DISTINCT {_NAMES.replace('{K}', kind('l_suppkey')).replace('{k}', 'l_suppkey')}, CAST(year(l_shipdate) - 1995 AS DOUBLE) AS t_min FROM {{lineitem}}"

# Catalogue of files, one per part, with paths in the archive's several styles.
CATALOG = """
SELECT p_partkey AS seq,
  CASE p_partkey % 8
    WHEN 0 THEN concat('datos/', tipo, '/', n, 'ant/Caso_', c, '/Potencia_', p, 'W/Fecha_', fecha, '/Tiempo_', tiempo, 'min/Prueba_', prueba, '/Zonas_4/archivo_', k, '.mat')
    WHEN 1 THEN concat('datos/', tipo, '/', n, 'ant/Caso_', c, '/Potencia_', p, 'W/', CASE WHEN p_partkey % 16 = 1 THEN concat(modelo, '_', dataset) ELSE concat('copia_', k) END, '.mat')
    WHEN 2 THEN concat('datos/', tipo, '/', n, 'ant/Caso_', c, '/Potencia_', p, 'W/correccion_', fecha, '_', tiempo, 'min_prueba_', prueba, '_zonas_4/archivo_', k, '.mat')
    WHEN 3 THEN concat('experimentos/', CASE n WHEN '1' THEN 'una antena' WHEN '2' THEN 'dos antenas' WHEN '3' THEN 'tres antenas' ELSE 'cuatro antenas' END,
                       '/', CASE prueba WHEN '1' THEN 'Primer' WHEN '2' THEN 'segundo' ELSE 'tercer' END, ' experimento/', tipo, '/Caso_', c, '/', p, ' W/historial_', k, '.mat')
    WHEN 4 THEN concat('D:', chr(92), 'datos', chr(92), lower(tipo), chr(92), n, '_ant', chr(92), 'c', c, '_p', p, '_s', chr(92), 'indice_', k, '.mat')
    WHEN 5 THEN concat('datos/Repetidos/', tipo, '/', n, 'ant/Caso_', c, '/Potencia_', p, 'W/archivo_', k, '.mat')
    WHEN 6 THEN concat('modelo_', tipo, '_', n, 'ant_dset_c', c, '_p', p, '_k', k, '.mat')
    ELSE concat('otros/sin_identidad_', k, '.txt') END AS ruta,
  concat('fuente_', CAST(p_size % 7 AS STRING), '.mat') AS fuente, modelo, dataset, concat(modelo, '__', dataset) AS partition_key,
  tipo, concat(n, 'ant') AS antena, CAST(p_partkey % 4 + 1 AS DOUBLE) AS num_antenas, CAST(p_partkey % 9 AS DOUBLE) AS caso,
  CASE p_size % 3 WHEN 0 THEN 10.0E0 WHEN 1 THEN 12.5E0 ELSE CAST(p_size AS DOUBLE) END AS potencia_w,
  fecha, concat('Tiempo_', tiempo, 'min') AS tiempo, concat('Prueba_', prueba) AS prueba, concat('Zonas_', CAST(p_partkey % 2 + 3 AS STRING)) AS zonas,
  CAST(1000000 + p_partkey * 7919 % 5000000 AS BIGINT) AS bytes, 739000 + p_retailprice AS mtime_days
FROM (SELECT p_partkey, p_size, p_retailprice, {K} AS tipo, CAST(p_partkey % 4 + 1 AS STRING) AS n, CAST(p_partkey % 9 AS STRING) AS c,
             CASE p_size % 3 WHEN 0 THEN '10' WHEN 1 THEN '12p5' ELSE CAST(p_size AS STRING) END AS p, CAST(p_partkey AS STRING) AS k,
             concat(CASE WHEN p_partkey % 2 = 0 THEN 'junio_' ELSE 'mayo_' END, CAST(p_partkey % 5 + 1 AS STRING)) AS fecha,
             CAST(5 * (p_partkey % 4 + 1) AS STRING) AS tiempo, CAST(p_partkey % 3 + 1 AS STRING) AS prueba,
             concat('modelo_', {K}, '_', CAST(p_partkey % 4 + 1 AS STRING), 'ant',
                    CASE p_partkey % 5 WHEN 1 THEN '_pendientes' WHEN 2 THEN '__src_A7' WHEN 3 THEN '_r2' ELSE '' END) AS modelo,
             concat('dset_c', CAST(p_partkey % 9 AS STRING), '_p', CASE p_size % 3 WHEN 0 THEN '10' WHEN 1 THEN '12' ELSE CAST(p_size AS STRING) END) AS dataset
      FROM {part}) q
""".replace("{K}", kind("p_partkey"))

# Corrections by supplier; some leave a field open.
CORRECTIONS = """
SELECT s_suppkey AS corr_id, CASE WHEN s_suppkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE {K} END AS tipo,
       CASE WHEN s_suppkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE concat(CAST(s_suppkey % 4 + 1 AS STRING), 'ant') END AS antena,
       CASE WHEN s_suppkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(s_nationkey % 9 AS DOUBLE) END AS caso,
       CASE WHEN s_suppkey % 3 = 0 THEN 10.0E0 WHEN s_suppkey % 3 = 1 THEN 12.5E0 ELSE CAST(NULL AS DOUBLE) END AS potencia_w
FROM {supplier}
""".replace("{K}", kind("s_suppkey"))

# Entries of the sweep's index: every order is one, several may stand for one (model, case, power).
_ENTRY = """concat('m', CAST(CAST(floor(o_custkey / 10) AS BIGINT) AS STRING)) AS modelo, CAST(o_orderkey % 9 AS INT) AS idx_caso,
             CAST(CAST(substring(o_orderpriority, 1, 1) AS INT) * 10 AS INT) AS p_ant, o_orderstatus AS st, o_orderkey AS ok"""
_STATE = "CASE st WHEN 'F' THEN 'OK' WHEN 'O' THEN CASE WHEN ok % 3 = 0 THEN 'CARBON_SOSTENIDA_MIN1' ELSE 'FALLO' END ELSE 'EN_CURSO' END AS estado, ok AS seq"
ENTRIES = f"SELECT modelo, idx_caso, p_ant, CAST(p_ant * 2 AS DOUBLE) AS p_tot, {_STATE} FROM (SELECT {_ENTRY} FROM {{orders}}) s"
# The entry that a look-up finds: the first of its (model, case, power).
FIRST_ENTRIES = f"""SELECT modelo, idx_caso, p_ant, CAST(p_ant * 2 AS DOUBLE) AS p_tot, {_STATE}
FROM (SELECT {_ENTRY},
             row_number() OVER (PARTITION BY CAST(floor(o_custkey / 10) AS BIGINT), o_orderkey % 9, substring(o_orderpriority, 1, 1) ORDER BY o_orderkey) AS rn
      FROM {{orders}}) s WHERE rn = 1"""

# Sweep solutions: one row per (model, case, power).
SOLUTION = """
SELECT modelo, idx_caso, p_ant, CAST(p_ant * 2 AS DOUBLE) AS p_tot,
       CASE st WHEN 'F' THEN 'OK' WHEN 'O' THEN CASE WHEN ok % 3 = 0 THEN 'CARBON_SOSTENIDA_MIN1' ELSE 'FALLO' END ELSE 'EN_CURSO' END AS estado, ok AS seq
FROM (SELECT concat('m', CAST(CAST(floor(o_custkey / 10) AS BIGINT) AS STRING)) AS modelo, CAST(o_orderkey % 9 AS INT) AS idx_caso,
             CAST(CAST(substring(o_orderpriority, 1, 1) AS INT) * 10 AS INT) AS p_ant, max(o_orderstatus) AS st, max(o_orderkey) AS ok
      FROM {orders} GROUP BY 1, 2, 3) s
"""

# Occupied voxels of a supplier's mask.
MASK = """
SELECT DISTINCT l_suppkey AS dist_id, CAST(l_quantity - 1 AS INT) AS ix, CAST(floor(l_discount * 100 + 0.5) AS INT) AS iy,
       CAST(floor(l_tax * 100 + 0.5) AS INT) AS iz FROM {lineitem}
"""

# One sheared box per supplier as twelve facets, and lineitems as query points around it.
BOX_SIZE = "SELECT s_suppkey AS mesh_id, 5.0E0 + s_suppkey % 7 AS a, 4.0E0 + s_suppkey % 5 AS b, 6.0E0 + s_suppkey % 3 AS c FROM {supplier}"
_CUBE = """(VALUES (0, 0,0,0, 0,1,0, 1,1,0), (1, 0,0,0, 1,1,0, 1,0,0), (2, 0,0,1, 1,0,1, 1,1,1), (3, 0,0,1, 1,1,1, 0,1,1),
(4, 0,0,0, 1,0,0, 1,0,1), (5, 0,0,0, 1,0,1, 0,0,1), (6, 0,1,0, 0,1,1, 1,1,1), (7, 0,1,0, 1,1,1, 1,1,0),
(8, 0,0,0, 0,0,1, 0,1,1), (9, 0,0,0, 0,1,1, 0,1,0), (10, 1,0,0, 1,1,0, 1,1,1), (11, 1,0,0, 1,1,1, 1,0,1))
AS u(facet_id, x1,y1,z1, x2,y2,z2, x3,y3,z3)"""
FACET_FLAT = f"""
SELECT mesh_id, CAST(facet_id AS BIGINT) AS facet_id,
       x1 * a + 0.25E0 * z1 * c AS x1, y1 * b AS y1, z1 * c AS z1, x2 * a + 0.25E0 * z2 * c AS x2, y2 * b AS y2, z2 * c AS z2,
       x3 * a + 0.25E0 * z3 * c AS x3, y3 * b AS y3, z3 * c AS z3
FROM ({BOX_SIZE}) s CROSS JOIN {_CUBE}
"""
# One mesh file per supplier; some lie in quarantine, some name no type.
MESH_FILES = """
SELECT s_suppkey AS mesh_id, concat('stl/', CASE WHEN s_suppkey % 13 = 0 THEN 'Repetidos/' ELSE '' END, CASE WHEN s_suppkey % 11 = 0 THEN 'otro' ELSE {K} END, '/', CAST(s_suppkey % 4 + 1 AS STRING),
       'ant/Caso_', CAST(s_suppkey % 9 AS STRING), '/Potencia_', CASE s_suppkey % 3 WHEN 0 THEN '5' WHEN 1 THEN '10' ELSE '12p5' END, 'W/Tiempo_', CAST(s_suppkey % 5 AS STRING), 'min/malla_k', CAST(s_suppkey AS STRING), '.stl') AS ruta,
       CAST(684 AS BIGINT) AS bytes, 739000 + s_suppkey / 8 AS mtime_days FROM {supplier}
""".replace("{K}", kind("s_suppkey"))
MESH_POINTS = """
SELECT l_suppkey AS mesh_id, l_orderkey * 8 + l_linenumber AS qid, min(l_quantity) / 4 - 0.137E0 AS x, min(l_discount) * 100 - 1.213E0 AS y,
       min(l_tax) * 100 * 1.25E0 - 0.731E0 AS z
FROM {lineitem} GROUP BY l_suppkey, l_orderkey * 8 + l_linenumber
"""

# Pixels: every embedding is an 8 x 8 image.
PIXEL_SPARK = """
SELECT image_id, CAST(floor(p / 8) AS INT) + 1 AS row, p % 8 + 1 AS col, least(1.0E0, greatest(0.0E0, 0.5E0 + v * 1.5E0)) AS r,
       least(1.0E0, greatest(0.0E0, 0.45E0 + w * 1.5E0)) AS g, least(1.0E0, greatest(0.0E0, 0.35E0 + u * 1.5E0)) AS b
FROM (SELECT vec_id AS image_id, p, CAST(e AS DOUBLE) AS v, CAST(embedding[(p + 1) % 64] AS DOUBLE) AS w, CAST(embedding[(p + 9) % 64] AS DOUBLE) AS u
      FROM {embeddings} LATERAL VIEW posexplode(embedding) x AS p, e) q
"""
PIXEL_DUCK = """
SELECT image_id, CAST(floor(p / 8) AS INT) + 1 AS row, CAST(p % 8 + 1 AS INT) AS col, least(1.0, greatest(0.0, 0.5 + v * 1.5)) AS r,
       least(1.0, greatest(0.0, 0.45 + w * 1.5)) AS g, least(1.0, greatest(0.0, 0.35 + u * 1.5)) AS b
FROM (SELECT vec_id AS image_id, p, CAST(embedding[p + 1] AS DOUBLE) AS v, CAST(embedding[(p + 1) % 64 + 1] AS DOUBLE) AS w,
             CAST(embedding[(p + 9) % 64 + 1] AS DOUBLE) AS u
      FROM embeddings, (SELECT CAST(range AS INT) AS p FROM range(64)) n) q
"""
