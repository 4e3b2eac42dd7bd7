"""Filters over catalogue rows, matching, upserts, ordered choices, set operations, summaries and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermal_lake.functions import geometry as G
from thermal_lake.functions import metadata as M
from thermal_lake.functions import textfmt as X
from thermal_lake.operators import catalog as K
from thermal_lake.plans import organise as O
from thermal_lake.sources import writers as W

from . import standins as S
from .core import R, query, rnd, sub, table, view
from .metadata_queries import _Q, CAT, SEM, _BD, _BM, gp, gs, identity_sql

SOL = sub(S.SOLUTION)


@query("F7_model_selection", f"""SELECT seq, ruta FROM ({CAT}) c WHERE (contains(lower(modelo), 'modelo') OR contains(lower(ruta), 'modelo')) AND (contains(lower(modelo), 'ant') OR contains(lower(ruta), 'ant'))
 AND (contains(lower(ruta), 'monopolo') OR contains(lower(ruta), 'un_slot')) AND (contains(lower(ruta), '1ant') OR contains(lower(ruta), '3ant'))""")
def model_selection(spark, d):
    return K.select_models(view(spark, d, S.CATALOG), "modelo", "ruta", ["Modelo", "ant"], ["Monopolo", "Un_slot"], [1, 3]).select("seq", "ruta")


@query("F8_dataset_selection", f"""SELECT seq, CASE WHEN caso_n IS NULL THEN 'sin metadata' WHEN caso_n NOT IN (1.0, 2.0, 3.0) THEN 'caso fuera de filtros' WHEN potencia_w NOT IN (10.0, 12.5) THEN 'potencia fuera de filtros' END AS motivo
FROM (SELECT *, CASE WHEN seq % 10 > 0 THEN caso END AS caso_n FROM ({CAT}) c) t""")
def dataset_selection(spark, d):
    c = view(spark, d, S.CATALOG).withColumn("caso_n", F.when(F.col("seq") % 10 > 0, F.col("caso")))
    return c.select("seq", K.omission_reason(F.col("caso_n"), F.col("potencia_w"), [1, 2, 3], [10, 12.5]).alias("motivo"))


@query("F9_correction_metadata_filter", f"""SELECT seq, ruta FROM ({CAT}) c WHERE lower(tipo) = 'monopolo' AND lower(antena) = '2ant' AND abs(caso - 1) < 1e-9 AND lower(tiempo) = 'tiempo_10min'""")
def correction_filter(spark, d):
    return K.matching_corrections(view(spark, d, S.CATALOG), {"tipo": "MONOPOLO", "antena": "2Ant", "caso": 1.0, "tiempo": "tiempo_10MIN"}).select("seq", "ruta")


@query("F10_faceted_options", f"""WITH c AS ({CAT}), o AS (
 SELECT DISTINCT 'tipo' AS field, tipo AS value FROM c WHERE antena = '2ant' AND fecha = 'mayo_2' UNION SELECT DISTINCT 'antena', antena FROM c WHERE tipo = 'Monopolo' AND fecha = 'mayo_2'
 UNION SELECT DISTINCT 'fecha', fecha FROM c WHERE tipo = 'Monopolo' AND antena = '2ant' UNION SELECT DISTINCT 'prueba', prueba FROM c WHERE tipo = 'Monopolo' AND antena = '2ant' AND fecha = 'mayo_2'),
 n AS (SELECT *, CAST(nullif(regexp_extract(value, '([-+]?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS v FROM o)
SELECT field, value, CAST(row_number() OVER (PARTITION BY field ORDER BY CASE WHEN texts = 0 THEN v END NULLS FIRST, lower(value), value) AS INT) AS rank
FROM (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY field) AS texts FROM n) t""")
def faceted_options(spark, d):
    return K.facets(view(spark, d, S.CATALOG), ["tipo", "antena", "fecha", "prueba"], {"tipo": "Monopolo", "antena": "2ant", "fecha": "mayo_2"})


@query("F12_optional_metadata_filter", f"""SELECT seq FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'junio_1' END AS w, CASE WHEN seq % 3 = 0 THEN 4.0 END AS wc FROM ({CAT}) c) t
WHERE (w IS NULL OR lower(fecha) = w) AND (wc IS NULL OR abs(caso - wc) < 1e-9)""")
def optional_filter(spark, d):
    c = view(spark, d, S.CATALOG).withColumns({"w": F.when(F.col("seq") % 2 == 0, "junio_1"), "wc": F.when(F.col("seq") % 3 == 0, 4.0)})
    return c.where(K.passes_optional(F.col("fecha"), F.col("w")) & K.passes_optional(F.col("caso"), F.col("wc"), numeric=True)).select("seq")


@query("F13_power_cap", f"SELECT seq, num_antenas * potencia_w <= CASE WHEN num_antenas = 4 THEN 120 ELSE 100 END AS permitida FROM ({CAT}) c")
def power_cap(spark, d):
    return view(spark, d, S.CATALOG).select("seq", K.within_power_cap(F.col("num_antenas"), F.col("potencia_w"), G.total_power_limit(F.col("num_antenas"))).alias("permitida"))


@query("F17_dataset_validity", f"""WITH f AS (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) % 4 > 0), c AS (SELECT s_suppkey AS k, 'dset_c' || CAST(s_suppkey % 9 AS VARCHAR) || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '_p10' END AS dataset FROM supplier)
SELECT k, dataset FROM c WHERE (k % 8 = 0 OR k % 4 <> 0) AND k IN (SELECT l_suppkey FROM f)""")
def dataset_validity(spark, d):
    s = table(spark, d, "supplier")
    c = s.select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("modelo"), F.concat(F.lit("dset_c"), (F.col("s_suppkey") % 9).cast("string"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("_p10")).alias("dataset"),
                 F.when(F.col("s_suppkey") % 8 == 0, F.lit(1.0)).alias("caso"), F.when(F.col("s_suppkey") % 8 == 0, F.lit(1.0)).alias("potencia_w"))
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n % 4 > 0").select("l_suppkey")
    present = li.join(c, li.l_suppkey == c.k).select("modelo", "dataset")
    return K.valid_datasets(c, present).select("k", "dataset")


_COR = sub(S.CORRECTIONS)


@query("J1_correction_compatibility", f"""SELECT r.corr_id, count(*) AS n, CAST(sum(c.seq) AS BIGINT) AS seqs, min(c.ruta) AS primera FROM ({CAT}) c JOIN ({_COR}) r
 ON (r.tipo IS NULL OR contains(lower(c.modelo), lower(r.tipo))) AND (r.antena IS NULL OR lower(c.antena) = lower(r.antena)) AND (r.caso IS NULL OR abs(c.caso - r.caso) < 1e-9)
 AND (r.potencia_w IS NULL OR abs(c.potencia_w - r.potencia_w) < 1e-9) WHERE NOT {_Q} GROUP BY 1""")
def correction_compatibility(spark, d):
    return K.match_totals(view(spark, d, S.CATALOG), view(spark, d, S.CORRECTIONS), "n", {"seqs": "seq"}, {"primera": "ruta"})


def upserted(spark, d):
    """Rows already in the index, new rows, and the files that exist."""
    c = view(spark, d, S.CATALOG).withColumn("partition_key", F.when(F.col("seq") % 6 == 0, F.upper("partition_key")).otherwise(F.col("partition_key")))
    return c.where("seq % 2 = 0"), c.where("seq % 2 = 1"), c.where("seq % 17 <> 0").select("ruta")


@query("J12_index_upsert", f"""WITH c AS (SELECT *, seq % 2 AS side, CASE WHEN seq % 6 = 0 THEN upper(partition_key) ELSE partition_key END AS pk FROM ({CAT}) q WHERE ruta IN (SELECT ruta FROM ({CAT}) q2 WHERE seq % 17 <> 0)),
 r AS (SELECT *, regexp_replace(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0), '\\.[^.]*$', '') AS base FROM c),
 w AS (SELECT *, row_number() OVER (PARTITION BY lower(pk) ORDER BY (lower(base) = regexp_replace(lower(pk), '_+', '_', 'g')) DESC, side DESC, seq DESC) AS rn FROM r),
 a AS (SELECT lower(pk) AS k, fuente, min(side * 1000000000 + seq) AS o FROM c GROUP BY 1, 2), l AS (SELECT k, string_agg(fuente, '|' ORDER BY o) AS fuentes FROM a GROUP BY 1)
SELECT seq, ruta, fuente, lower(pk) AS clave, fuentes AS fuentes_equivalentes FROM w JOIN l ON l.k = lower(pk) WHERE rn = 1""")
def index_upsert(spark, d):
    sides = upserted(spark, d)
    index = K.with_aliases(K.upsert_index(*sides), K.alias_chunks(K.upsert_aliases(*sides)))
    return index.select("seq", "ruta", "fuente", F.lower("partition_key").alias("clave"), "fuentes_equivalentes")


@query("J12_alias_chunks", f"""WITH c AS (SELECT *, seq % 2 AS side, CASE WHEN seq % 6 = 0 THEN upper(partition_key) ELSE partition_key END AS pk FROM ({CAT}) q WHERE ruta IN (SELECT ruta FROM ({CAT}) q2 WHERE seq % 17 <> 0)),
 a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS rn FROM (SELECT lower(pk) AS k, fuente, min(side * 1000000000 + seq) AS o FROM c GROUP BY 1, 2) b)
SELECT k AS clave, CAST(floor((rn - 1) / 4) AS BIGINT) AS chunk, count(*) AS n, string_agg(fuente, '|' ORDER BY rn) AS fuentes_equivalentes FROM a GROUP BY 1, 2""")
def index_aliases(spark, d):
    return K.alias_chunks(K.upsert_aliases(*upserted(spark, d)), 4).withColumnRenamed("partition_key", "clave")


@query("J13_first_wins_merge", f"""WITH c AS ({CAT}), a AS (SELECT modelo, dataset, min(seq) AS seq FROM c WHERE seq % 3 = 0 GROUP BY 1, 2), b AS (SELECT modelo, dataset, min(seq) AS seq FROM c WHERE seq % 3 <> 0 GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.modelo = b.modelo AND a.dataset = b.dataset)""")
def first_wins_merge(spark, d):
    c = view(spark, d, S.CATALOG)
    side = lambda cond: c.where(cond).groupBy("modelo", "dataset").agg(F.min("seq").alias("seq"))
    return K.first_wins(side("seq % 3 = 0"), side("seq % 3 <> 0"), ["modelo", "dataset"])


@query("J14_original_corrected_pairing", f"""WITH c AS ({CAT}), o AS (SELECT * FROM c WHERE seq % 8 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY modelo, dataset ORDER BY seq) AS rn FROM c WHERE seq % 8 <> 1 AND lower(fecha) = 'junio_1')
SELECT o.seq, o.ruta, r.ruta AS ruta_corregida FROM o LEFT JOIN r ON r.modelo = o.modelo AND r.dataset = o.dataset AND r.rn = 1""")
def original_corrected(spark, d):
    c = view(spark, d, S.CATALOG)
    return K.pair_corrected(c.where("seq % 8 = 1"), c.where("seq % 8 <> 1"), "Junio_1").select("seq", "ruta", "ruta_corregida")


@query("J15_pending_points", f"""WITH s AS ({sub(S.FIRST_ENTRIES)}), m AS (SELECT DISTINCT modelo FROM s), g AS (SELECT modelo, CAST(c AS INT) AS idx_caso, CAST(p * 10 AS INT) AS p_ant FROM m, range(9) c(c), range(1, 6) p(p))
SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.modelo = g.modelo AND s.idx_caso = g.idx_caso AND s.p_ant = g.p_ant AND s.estado <> 'EN_CURSO')
 AND NOT EXISTS (SELECT 1 FROM s WHERE s.modelo = g.modelo AND s.idx_caso = g.idx_caso AND s.p_ant = 10 AND s.estado = 'CARBON_SOSTENIDA_MIN1')""")
def pending_points(spark, d):
    return K.pending_points(view(spark, d, S.ENTRIES), range(9), [10, 20, 30, 40, 50], "seq")


@query("J16_checkpoint_anti_join", f"""WITH c AS (SELECT seq, partition_key AS key, ruta || '|' || CAST(bytes AS VARCHAR) AS signature FROM ({CAT}) c)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.seq % 2 = 0 AND d.key = c.key AND CASE WHEN d.seq % 4 = 0 THEN d.signature ELSE 'x' END = c.signature)""")
def checkpoint_anti(spark, d):
    c = view(spark, d, S.CATALOG).select("seq", F.col("partition_key").alias("key"), F.concat("ruta", F.lit("|"), F.col("bytes").cast("string")).alias("signature"))
    done = c.where("seq % 2 = 0").withColumn("signature", F.when(F.col("seq") % 4 == 0, F.col("signature")).otherwise("x"))
    return K.not_current(c, done)


@query("J17_sidecar_merge", f"""WITH c AS (SELECT seq, CAST(seq AS VARCHAR) || '/' || ruta AS ruta, fuente AS carpeta, tipo, fecha FROM ({CAT}) q)
SELECT seq, ruta, coalesce(CASE WHEN seq % 5 = 0 THEN 'Propio' END, CASE WHEN carpeta IN ('fuente_1.mat', 'fuente_2.mat') THEN 'Carpeta' END, tipo) AS tipo,
 coalesce(CASE WHEN seq % 5 = 0 AND seq % 2 = 0 THEN 'hoy' END, CASE WHEN carpeta = 'fuente_2.mat' THEN 'ayer' END, fecha) AS fecha FROM c""")
def sidecar(spark, d):
    c = view(spark, d, S.CATALOG).select("seq", F.concat_ws("/", F.col("seq").cast("string"), "ruta").alias("ruta"), F.col("fuente").alias("carpeta"), "tipo", "fecha")
    own = c.where("seq % 5 = 0").select("ruta", F.lit("Propio").alias("tipo"), F.when(F.col("seq") % 2 == 0, "hoy").otherwise("").alias("fecha"))
    folder = c.select("carpeta").distinct().where(F.col("carpeta").isin("fuente_1.mat", "fuente_2.mat")).select(
        "carpeta", F.lit("Carpeta").alias("tipo"), F.when(F.col("carpeta") == "fuente_2.mat", "ayer").otherwise("").alias("fecha"))
    return K.with_sidecar(c, own, folder, ["tipo", "fecha"]).select("seq", "ruta", "tipo", "fecha")


@query("J18_antenna_lookup", f"""WITH l(antena, antenna, x, y, z) AS (VALUES ('1ant', 1, 0.0, 0.0, 0.0), ('2ant', 1, -10.0, 0.0, 0.0), ('2ant', 2, 10.0, 0.0, 0.0), ('3ant', 1, 0.0, 11.55, 0.0), ('3ant', 2, 10.0, -5.77, 0.0), ('3ant', 3, -10.0, -5.77, 0.0),
 ('4ant', 1, -10.0, -10.0, 0.0), ('4ant', 2, 10.0, -10.0, 0.0), ('4ant', 3, -10.0, 10.0, 0.0), ('4ant', 4, 10.0, 10.0, 0.0))
SELECT c.seq, l.antena, CAST(l.antenna AS INT) AS antenna, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (SELECT seq, CASE WHEN seq % 9 = 0 THEN '5ant' ELSE antena END AS antena FROM ({CAT}) q) c JOIN l ON l.antena = c.antena""")
def antenna_lookup(spark, d):
    c = view(spark, d, S.CATALOG).select("seq", F.when(F.col("seq") % 9 == 0, "5ant").otherwise(F.col("antena")).alias("antena"))
    return K.with_antennas(c, G.placement_layout(spark))


@query("J20_exact_resolution", f"""WITH c AS ({CAT}), k AS (SELECT seq AS corr_id, lower(tipo) AS t, lower(antena) AS a, caso, potencia_w, fecha, tiempo, prueba, zonas FROM c WHERE seq % 2 = 0),
 w AS (SELECT seq, tipo, antena, caso, potencia_w, CASE WHEN seq % 13 > 0 THEN fecha END AS fecha, tiempo, prueba, zonas FROM c),
 f AS (SELECT t, a, caso, potencia_w, fecha, tiempo, prueba, zonas, count(*) AS n, min(corr_id) AS corr_id FROM k GROUP BY ALL)
SELECT w.seq, CASE WHEN f.n IS NULL THEN 'none' WHEN f.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(f.n, 0) AS n, CASE WHEN f.n = 1 THEN f.corr_id END AS corr_id
FROM w LEFT JOIN f ON lower(w.tipo) = f.t AND lower(w.antena) = f.a AND w.caso = f.caso AND w.potencia_w = f.potencia_w AND w.fecha = f.fecha AND w.tiempo = f.tiempo AND w.prueba = f.prueba AND w.zonas = f.zonas""")
def exact_resolution(spark, d):
    c = view(spark, d, S.CATALOG)
    fields = ["tipo", "antena", "caso", "potencia_w", "fecha", "tiempo", "prueba", "zonas"]
    wanted = c.select("seq", *fields).withColumn("fecha", F.when(F.col("seq") % 13 > 0, F.col("fecha")))
    return K.resolve_correction(wanted, c.where("seq % 2 = 0").withColumnRenamed("seq", "corr_id"), fields).select("seq", "status", "n", "corr_id")


@query("W3_sweep_early_stop", f"""WITH s AS ({SOL}), f AS (SELECT *, min(CASE WHEN estado = 'CARBON_SOSTENIDA_MIN1' THEN p_ant END) OVER (PARTITION BY modelo, idx_caso) AS stop FROM s)
SELECT modelo, idx_caso, p_ant, CASE WHEN p_ant > stop THEN 'SALTADO_CARBON' WHEN estado = 'FALLO' THEN 'FALLO' WHEN estado = 'CARBON_SOSTENIDA_MIN1' THEN estado ELSE 'OK' END AS estado FROM f""")
def sweep_early_stop(spark, d):
    s = view(spark, d, S.SOLUTION)
    runs = s.select("modelo", "idx_caso", "p_ant", (F.col("estado") == "FALLO").alias("failed"), (F.col("estado") == K.SUSTAINED).alias("carbon"))
    return K.sweep_states(runs).select("modelo", "idx_caso", "p_ant", "estado")


@query("W4_stable_dedup", f"SELECT tipo, antena, fecha, seq, ruta FROM (SELECT *, row_number() OVER (PARTITION BY tipo, antena, fecha ORDER BY seq) AS rn FROM ({CAT}) c) t WHERE rn = 1")
def stable_dedup(spark, d):
    return K.first_per_key(view(spark, d, S.CATALOG).select("tipo", "antena", "fecha", "seq", "ruta"), ["tipo", "antena", "fecha"])


_BASE = "regexp_replace(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0), '\\.[^.]*$', '')"
SCORE = f"""round((CASE WHEN seq % 3 = 0 THEN 1000.0E0 ELSE 0 END) + (CASE WHEN lower(modelo) = lower({_BM}) THEN 200 ELSE 0 END)
 + (CASE WHEN lower({_BASE}) = regexp_replace(lower({_BM} || '_' || {_BD}), '_+', '_', 'g') THEN 100 ELSE 0 END) + (CASE WHEN NOT contains(lower({_BASE}), 'pendientes') THEN 30 ELSE 0 END)
 + (CASE WHEN NOT contains(lower({_BASE}), '_src_') THEN 20 ELSE 0 END) + (CASE WHEN NOT regexp_matches({_BASE}, '_r\\d+$') THEN 10 ELSE 0 END) - length({_BASE}) / 1000.0E0, 9)"""


def scored_entries(spark, d):
    c = view(spark, d, S.CATALOG)
    model, data = M.base_model("modelo"), M.base_dataset("dataset", F.col("caso"), F.col("potencia_w"))
    c = c.withColumns({"_m": model, "_d": data, "_b": M.base_name("ruta")})
    return c.select("seq", "ruta", "bytes", F.col("mtime_days").alias("mtime"),
                    M.semantic_key(F.col("_m"), F.col("_d"), F.col("tipo"), F.col("antena"), F.col("caso"), F.col("potencia_w")).alias("clave_semantica"),
                    F.round(K.tidiness(F.col("seq") % 3 == 0, F.col("modelo"), F.col("_m"), F.col("_b"), F.col("_d")), 9).alias("puntaje"))


_ENT = f"SELECT seq, ruta, bytes, mtime_days AS mtime, {SEM} AS clave_semantica, {SCORE} AS puntaje FROM ({CAT}) c"


@query("W5_canonical_selection", f"""SELECT clave_semantica, seq, ruta, puntaje FROM (SELECT *, row_number() OVER (PARTITION BY clave_semantica ORDER BY puntaje DESC, mtime DESC, seq) AS rn FROM ({_ENT}) e) t WHERE rn = 1""")
def canonical_selection(spark, d):
    return K.canonical_rows(scored_entries(spark, d), "clave_semantica", "puntaje", "mtime", "seq").select("clave_semantica", "seq", "ruta", "puntaje")


RES = """SELECT p_partkey AS seq, p_brand, concat('Geometria_', p_type, '_mascara_res', CASE p_size % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '1' WHEN 2 THEN '1.5' ELSE 'x' END) AS nombre, p_type FROM {part}"""


@query("W6_preferred_resolution", f"""SELECT p_brand, p_type, seq, resolution FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY coalesce(abs(resolution - 0.9), 1e300), coalesce(resolution, 1e300), seq) AS rn
 FROM (SELECT *, try_cast(nullif(regexp_extract(nombre, '_mascara_res([\\d.]+)$', 1), '') AS DOUBLE) AS resolution FROM ({sub(RES)}) r) t) u WHERE rn = 1""")
def preferred_resolution(spark, d):
    r = view(spark, d, RES).withColumn("resolution", K.resolution_of(F.col("nombre"), "mascara"))
    return K.preferred_resolution(r.select("p_brand", "p_type", "seq", "resolution"), ["p_brand", "p_type"], 0.9)


@query("W13_revision_numbering", f"""WITH s AS (SELECT p_brand, max(p_size) AS top FROM part WHERE p_partkey % 5 = 0 AND p_size > 30 GROUP BY 1)
SELECT p_partkey, part.p_brand, CAST(greatest(1, coalesce(top, 1)) + row_number() OVER (PARTITION BY part.p_brand ORDER BY p_partkey) AS BIGINT) AS revision FROM part LEFT JOIN s USING (p_brand) WHERE p_partkey % 5 <> 0""")
def revision_numbering(spark, d):
    p = table(spark, d, "part")
    stored = p.where("p_partkey % 5 = 0 AND p_size > 30").select("p_brand", F.col("p_size").alias("revision"))
    return K.number_revisions(p.where("p_partkey % 5 <> 0").select("p_partkey", "p_brand"), stored, ["p_brand"], "p_partkey")


@query("W14_best_run", """SELECT o_custkey, o_orderkey, best, mejor FROM (SELECT o_custkey, o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best,
 first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS mejor FROM orders) t""")
def best_run(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("fitness"), F.col("o_orderkey").alias("seq"))
    run = K.best_so_far(o, ["o_custkey"], "seq").select("o_custkey", "o_orderkey", "best")
    best = K.best_run(o, ["o_custkey"]).select("o_custkey", F.col("o_orderkey").alias("mejor"))
    return run.join(best, "o_custkey")


@query("O1_multi_key_sort", """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INT) AS pos FROM orders""")
def multi_key_sort(spark, d):
    from pyspark.sql.window import Window
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")).alias("pos"))


@query("O2_natural_sort", """WITH v AS (SELECT DISTINCT p_type AS grp, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'Caso_' || CAST(p_size AS VARCHAR) ELSE p_name || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END END AS value FROM part),
 n AS (SELECT *, CAST(nullif(regexp_extract(value, '([-+]?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS num FROM v)
SELECT grp, value, CAST(row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN texts = 0 THEN num END NULLS FIRST, lower(value), value) AS INT) AS rank FROM (SELECT *, sum(CASE WHEN num IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY grp) AS texts FROM n) t""")
def natural_sort(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_type").isin("ECONOMY", "LARGE"), F.concat(F.lit("Caso_"), size)).otherwise(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, size).otherwise("")))
    return K.natural_rank(p.select(F.col("p_type").alias("grp"), value.alias("value")).distinct(), ["grp"])


@query("O6_first_match", """SELECT doc_id, nullif(regexp_extract(text, '([A-Z][a-z]+)', 1), '') AS palabra, source, min(doc_id) OVER (PARTITION BY source) AS primero FROM documents""")
def first_match(spark, d):
    t = table(spark, d, "documents")
    first = K.first_per_key(t.select("source", F.col("doc_id").alias("primero"), F.col("doc_id").alias("seq")), ["source"]).select("source", "primero")
    return t.select("doc_id", "source", M.extract("text", "([A-Z][a-z]+)").alias("palabra")).join(first, "source").select("doc_id", "palabra", "source", "primero")


@query("U1_stable_union", """SELECT k AS k, CASE WHEN a IS NOT NULL THEN 0 ELSE 1 END AS side, coalesce(a, b) AS seq FROM (SELECT coalesce(x.k, y.k) AS k, a, b FROM (SELECT p_name AS k, min(p_partkey) AS a FROM part WHERE p_size < 25 GROUP BY 1) x
 FULL JOIN (SELECT p_name AS k, min(p_partkey) AS b FROM part WHERE p_size >= 10 GROUP BY 1) y ON x.k = y.k) t""")
def stable_union(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("k"), F.col("p_partkey").alias("seq"), "p_size")
    return K.stable_union(p.where("p_size < 25"), p.where("p_size >= 10"), "k")


@query("U2_intersection", """SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey + c_nationkey % 3 * 1000000 FROM customer)""")
def intersection(spark, d):
    o = table(spark, d, "orders").select("o_custkey").distinct()
    return K.still_valid(o, table(spark, d, "customer").select((F.col("c_custkey") + F.col("c_nationkey") % 3 * 1000000).alias("o_custkey")), "o_custkey")


U3 = "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'session_meta' WHEN 1 THEN 'source_signature' WHEN 2 THEN 'datasets_omitidos' ELSE concat('dset_', CAST(o_orderkey AS STRING)) END AS name FROM {orders}"


@query("U3_reserved_keys", f"SELECT * FROM ({sub(U3)}) t WHERE name NOT IN ('session_meta', 'source_signature', 'datasets_omitidos')")
def reserved(spark, d):
    return K.without_reserved(view(spark, d, U3))


@query("U4_distinct", f"SELECT DISTINCT modelo, dataset FROM ({CAT}) c")
def distinct(spark, d):
    return view(spark, d, S.CATALOG).select("modelo", "dataset").distinct()


@query("U5_append_with_fill", """SELECT c_custkey AS id, c_acctbal AS saldo, 'cliente' AS rol, c_mktsegment AS segmento FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'sin rol', NULL FROM supplier""")
def append_fill(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("saldo"), F.lit("cliente").alias("rol"), F.col("c_mktsegment").alias("segmento"))
    return K.append_filled(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("saldo")), {"rol": "sin rol"})


@query("A6_inventory_summary", f"""WITH c AS (SELECT *, lower(modelo || '__' || dataset || '__' || fecha) AS clave_visual FROM ({CAT}) q)
SELECT fuente AS archivo, count(DISTINCT modelo) AS modelos, count(DISTINCT (modelo, dataset)) AS datasets, {R('max(bytes) / 1024.0E0 / 1024 / 1024', 9)} AS gib,
 (SELECT count(DISTINCT clave_visual) FROM c) AS claves, (SELECT count(*) - count(DISTINCT clave_visual) FROM c) AS colapsan FROM c GROUP BY fuente""")
def inventory_summary(spark, d):
    c = view(spark, d, S.CATALOG).withColumns({"clave_visual": F.lower(F.concat_ws("__", "modelo", "dataset", "fecha")), "archivo": F.col("fuente"), "_k": F.lit(0)})
    whole = K.collapse_counts(c).select("claves", "colapsan", F.lit(0).alias("_k"))
    return K.inventory_summary(c).withColumn("gib", rnd("gib", 9)).withColumn("_k", F.lit(0)).join(whole, "_k").drop("_k")


@query("A7_state_counts", f"SELECT modelo, estado, count(*) AS count FROM ({SOL}) s GROUP BY 1, 2 UNION ALL SELECT NULL, estado, count(*) FROM ({SOL}) s GROUP BY 2")
def state_counts(spark, d):
    return K.state_counts(view(spark, d, S.SOLUTION)).select("modelo", "estado", "count")


def _list(c):
    return F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")


_LISTS = ", ".join(f"string_agg(DISTINCT CAST(CAST({c} AS INT) AS VARCHAR), ',' ORDER BY CAST(CAST({c} AS INT) AS VARCHAR)) AS {c}" for c in ("idx_caso",))


@query("A8_distinct_values", f"SELECT modelo, {_LISTS}, (SELECT string_agg(v, ',') FROM (SELECT DISTINCT p_ant, CAST(p_ant AS VARCHAR) AS v FROM ({SOL}) z WHERE z.modelo = s.modelo ORDER BY p_ant)) AS p_ant FROM ({SOL}) s GROUP BY modelo")
def distinct_values(spark, d):
    return K.distinct_lists(view(spark, d, S.SOLUTION)).select("modelo", _list("idx_caso").alias("idx_caso"), _list("p_ant").alias("p_ant"))


@query("A9_extraction_summary", f"""WITH f AS ({sub(S.FIELD)}), s AS (SELECT modelo, dataset, t_idx, t_min, sum(CASE WHEN t_c >= 55 THEN 1 ELSE 0 END) AS n FROM f GROUP BY 1, 2, 3, 4), o AS (SELECT modelo, count(*) AS omitted FROM ({CAT}) c WHERE seq % 5 = 0 GROUP BY 1)
SELECT coalesce(a.modelo, o.modelo) AS modelo, snapshots, min_filtered, max_filtered, t_first, t_last, coalesce(omitted, 0) AS omitted FROM (SELECT modelo, count(*) AS snapshots, CAST(min(n) AS BIGINT) AS min_filtered, CAST(max(n) AS BIGINT) AS max_filtered, min(t_min) AS t_first, max(t_min) AS t_last FROM s GROUP BY 1) a FULL JOIN o ON a.modelo = o.modelo""")
def extraction_summary(spark, d):
    from thermal_lake.operators import field as FL
    stats = FL.instant_stats(view(spark, d, S.FIELD), ("modelo", "dataset", "t_idx", "t_min"))
    return K.extraction_summary(stats, view(spark, d, S.CATALOG).where("seq % 5 = 0"))


@query("A20_alias_union", f"""WITH c AS (SELECT lower(partition_key) AS partition_key, seq, CASE WHEN seq % 3 = 0 THEN 'fuente_1.mat|' || fuente || '||fuente_9.mat' ELSE '' END AS eq, fuente FROM ({CAT}) q),
 a AS (SELECT partition_key, seq, u.alias, u.pos - 1 AS pos FROM c, LATERAL (SELECT unnest(list_append(string_split(eq, '|'), fuente)) AS alias, generate_subscripts(list_append(string_split(eq, '|'), fuente), 1) AS pos) u WHERE u.alias <> '')
SELECT partition_key, alias, seq, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY partition_key, alias ORDER BY seq, pos) AS rn FROM a) t WHERE rn = 1""")
def alias_union(spark, d):
    c = view(spark, d, S.CATALOG)
    eq = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("fuente_1.mat|"), "fuente", F.lit("||fuente_9.mat")))
    return K.alias_table(c.withColumn("fuentes_equivalentes", eq)).select("partition_key", "alias", "seq", "pos")


@query("A23_selected_bytes", f"SELECT tipo, antena, count(*) AS n, {R('sum(bytes) / 1e9', 9)} AS gb FROM ({CAT}) c WHERE caso = 3 GROUP BY 1, 2")
def selected_bytes(spark, d):
    return K.selected_size(view(spark, d, S.CATALOG).where("caso = 3"), ["tipo", "antena"]).withColumn("gb", rnd("gb", 9))


DOCS = """SELECT doc_id AS seq, CAST(doc_id AS STRING) AS ruta, concat(lower(source), '|', lang, '|', CAST(CAST(floor(n_chars / 40) AS BIGINT) AS STRING)) AS clave_semantica,
 CAST(doc_id % 3 * 10 AS DOUBLE) - length(source) / 1000.0E0 AS puntaje, CAST(n_chars AS DOUBLE) AS mtime, text FROM {documents}"""


# Every 23rd document cannot be read.
UNREAD = "CAST(ruta AS BIGINT) % 23 = 5"
_REASON = "'misma metadata con contenido diferente o no verificable'"


@query("C12_duplicate_organisation", f"""WITH e AS (SELECT *, {UNREAD} AS bad, 'bloque ' || ruta AS error FROM ({sub(DOCS)}) q), c AS (SELECT *, first_value(ruta) OVER w AS canonica, first_value(text) OVER w AS t, first_value(bad) OVER w AS bad_best, first_value(error) OVER w AS error_best
 FROM e WINDOW w AS (PARTITION BY clave_semantica ORDER BY puntaje DESC, mtime DESC, seq)), k AS (SELECT *, CASE WHEN ruta = canonica THEN 'canonico' WHEN text = t AND NOT bad AND NOT bad_best THEN 'equivalente' ELSE 'conflicto' END AS category FROM c)
SELECT ruta, clave_semantica, canonica, category, CASE category WHEN 'canonico' THEN 'mejor puntaje' WHEN 'equivalente' THEN 'contenido termico identico' ELSE {_REASON} || CASE WHEN bad_best THEN ' (canonico ilegible: ' || error_best || ')' WHEN bad THEN ' (comparacion fallida: ' || error || ')' ELSE '' END END AS reason FROM k""")
def duplicate_organisation(spark, d):
    e = view(spark, d, DOCS).withColumn("bad", F.expr(UNREAD))
    digest = O.content_digest(e.where("NOT bad").select("ruta", "text"), "ruta")
    entries = e.drop("text").join(digest, "ruta", "left").withColumn("error", F.when(F.col("bad"), F.concat(F.lit("bloque "), "ruta")))
    return O.organise(entries, e.where("NOT bad").select("ruta", "text"), ["text"]).select("ruta", "clave_semantica", "canonica", "category", "reason")


@query("C12_without_comparison", f"""SELECT ruta, canonica, CASE WHEN ruta = canonica THEN 'canonico' ELSE 'conflicto' END AS category, CASE WHEN ruta = canonica THEN 'mejor puntaje' ELSE {_REASON} || ' (comparacion deshabilitada)' END AS reason
FROM (SELECT ruta, first_value(ruta) OVER (PARTITION BY clave_semantica ORDER BY puntaje DESC, mtime DESC, seq) AS canonica FROM ({sub(DOCS)}) e) c""")
def organisation_without_comparison(spark, d):
    e = view(spark, d, DOCS).drop("text").withColumn("digest", F.lit(None).cast("string"))
    return O.organise(e, compare=False).select("ruta", "canonica", "category", "reason")


@query("C12_exact_content_check", f"""WITH e AS ({sub(DOCS)}), c AS (SELECT *, first_value(ruta) OVER (PARTITION BY clave_semantica ORDER BY seq) AS canonica, first_value(text) OVER (PARTITION BY clave_semantica ORDER BY seq) AS t FROM e)
SELECT ruta AS copy, text = t AS equal FROM c WHERE ruta <> canonica""")
def exact_content(spark, d):
    e = view(spark, d, DOCS)
    best = e.groupBy("clave_semantica").agg(F.min_by("ruta", "seq").alias("canonical"))
    pairs = e.join(best, "clave_semantica").where("ruta != canonical").select(F.col("ruta").alias("copy"), "canonical")
    return O.equal_rows(e.select("ruta", "text"), pairs, "ruta", ["text"])


_INV = f"""SELECT seq, ruta, modelo, CASE WHEN seq % 29 = 0 THEN 'session_meta' ELSE dataset END AS dataset, bytes, seq % 3 = 0 AS has_snapshots, seq % 5 > 0 AS has_full_field, false AS has_probes,
 CASE WHEN seq % 4 = 0 THEN caso END AS caso_meta, CASE WHEN seq % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE potencia_w END AS potencia_meta FROM ({S.CATALOG}) c"""


@query("C13_split_archive", f"""WITH i AS (SELECT *, CASE WHEN contains(modelo, 'Doble_slot') THEN 'Doble_slot' WHEN contains(modelo, 'Monopolo') THEN 'Monopolo' WHEN contains(modelo, 'Un_slot') THEN 'Un_slot' END AS tipo,
  try_cast(nullif(regexp_extract(modelo, '(\\d+)ant', 1), '') AS DOUBLE) AS n_ant, coalesce(caso_meta, CAST(nullif(regexp_extract(dataset, 'c(\\d+)_', 1), '') AS DOUBLE)) AS caso,
  coalesce(potencia_meta, CAST(nullif(regexp_extract(dataset, '_p(\\d+)$', 1), '') AS DOUBLE)) AS potencia_w FROM ({sub(_INV)}) t WHERE dataset <> 'session_meta')
SELECT seq, tipo || '/' || CAST(CAST(n_ant AS INT) AS VARCHAR) || 'ant/Caso_' || CAST(CAST(caso AS INT) AS VARCHAR) || '/Potencia_' || {gp('potencia_w')} || 'W' AS carpeta, modelo || '__' || dataset AS partition_key
FROM i WHERE (has_snapshots OR has_full_field) AND seq % 10 <> 0""")
def split_archive(spark, d):
    inv = view(spark, d, _INV)
    done = inv.where("seq % 10 = 0").select(F.lower(F.concat_ws("__", "modelo", "dataset")).alias("key"), F.concat_ws("|", "ruta", F.col("bytes").cast("string")).alias("signature"))
    index = view(spark, d, S.CATALOG).select("ruta", "fuente", "modelo", "dataset", "partition_key", "tipo", "antena", "num_antenas", "caso", "potencia_w", "seq").limit(0)
    return O.split_archive(inv, index, done)["routes"].select("seq", "carpeta", "partition_key")


_NM = "'(sin metadata)'"
_I = identity_sql(f"SELECT seq, CASE WHEN seq % 11 = 0 THEN 'reconstruccion/' || ruta ELSE ruta END AS ruta FROM ({CAT}) c WHERE NOT {_Q}")


def _in(c):
    return f"coalesce(CAST(CAST(round({c}) AS INT) AS VARCHAR), {_NM})"


@query("C25_distribution_catalog", f"""SELECT ruta, origen, coalesce(i_tipo, {_NM}) AS tipo, coalesce(i_antena, {_NM}) AS arreglo, {_in('i_caso')} AS caso, coalesce('Potencia_' || {gp('i_potencia_w')} || 'W', 'Potencia_desconocida') AS potencia,
 coalesce(i_fecha, {_NM}) AS fecha, {_in('i_tiempo')} AS tiempo, {_in('i_prueba')} AS prueba, {_in('i_num_zonas')} AS zonas FROM (SELECT *, CASE WHEN contains(lower(s), 'reconstruccion') THEN 'reconstruccion' WHEN contains(lower(s), 'correccion') OR i_fecha IS NOT NULL THEN 'corregido' ELSE 'original' END AS origen FROM ({_I}) t) u
WHERE CASE origen WHEN 'reconstruccion' THEN i_num_antenas IS NOT NULL AND i_prueba IS NOT NULL WHEN 'corregido' THEN i_sim AND i_acq ELSE i_sim END""")
def distribution_catalog(spark, d):
    c = view(spark, d, S.CATALOG).select(F.when(F.col("seq") % 11 == 0, F.concat(F.lit("reconstruccion/"), "ruta")).otherwise(F.col("ruta")).alias("ruta"))
    return K.distribution_catalog(c).drop("resolucion")


@query("C26_correction_catalog", f"SELECT seq, ruta, i_tipo AS tipo, i_fecha AS fecha_adquisicion, i_num_zonas AS num_zonas FROM ({identity_sql(f'SELECT seq, ruta FROM ({CAT}) c WHERE NOT {_Q}')}) t WHERE i_sim AND i_acq")
def correction_catalog(spark, d):
    return K.correction_catalog(view(spark, d, S.CATALOG).select("seq", "ruta")).select("seq", "ruta", "tipo", "fecha_adquisicion", "num_zonas")


@query("C27_progress_report", f"""SELECT modelo, count(*) FILTER (estado = 'OK') AS ok, count(*) FILTER (estado = 'CARBON_SOSTENIDA_MIN1') AS carbon, count(*) FILTER (estado = 'FALLO') AS fallo, count(DISTINCT idx_caso) AS casos, count(DISTINCT p_ant) AS potencias FROM ({SOL}) s GROUP BY 1""")
def progress_report(spark, d):
    r = K.progress_report(view(spark, d, S.SOLUTION))
    return r.select("modelo", F.col("OK").alias("ok"), F.col(K.SUSTAINED).alias("carbon"), F.col("FALLO").alias("fallo"), F.size("idx_caso").cast("long").alias("casos"), F.size("p_ant").cast("long").alias("potencias"))


@query("C31_cleaning_targets", f"""SELECT seq, ruta FROM ({CAT}) c WHERE tipo = 'Un_slot' AND antena = '1ant' AND caso = 8 AND potencia_w = 10 AND fecha = 'junio_4' AND tiempo = 'Tiempo_5min' AND prueba = 'Prueba_3' AND zonas = 'Zonas_3'
UNION ALL SELECT seq, ruta FROM ({CAT}) c WHERE false""")
def cleaning_targets(spark, d):
    c = view(spark, d, S.CATALOG)
    wanted = {"tipo": "un_slot", "antena": "1ant", "caso": 8.0, "potencia_w": 10.0, "fecha": "junio_4", "tiempo": "tiempo_5min", "prueba": "prueba_3", "zonas": "zonas_3"}
    refused = K.cleaning_targets(c, {**wanted, "fecha": ""})
    return K.cleaning_targets(c, wanted).unionByName(refused).select("seq", "ruta")


@query("S15_correction_revisions", """WITH p AS (SELECT p_partkey AS seq, p_brand AS path, p_name, p_size FROM part), m AS (SELECT path, p_name AS n, p_size AS z FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS rn FROM p WHERE path < 'Brand#20') t WHERE rn = 1),
 s AS (SELECT p.seq, p.path, CASE WHEN m.path IS NULL THEN 'principal' WHEN p.p_name = m.n THEN 'equivalentes' ELSE 'conflictos' END AS category FROM p LEFT JOIN m USING (path))
SELECT seq, path, category, CASE category WHEN 'principal' THEN 1 ELSE 1 + row_number() OVER (PARTITION BY path, category ORDER BY seq) END AS revision FROM s""")
def correction_revisions(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("path"), "p_name", "p_size")
    stored = K.first_per_key(p.where("path < 'Brand#20'"), ["path"]).select("path", "p_name", F.lit("principal").alias("category"), F.lit(1).cast("long").alias("revision"))
    return W.classify_corrections(p.select("seq", "path", "p_name"), stored, ["p_name"]).select("seq", "path", "category", "revision")


@query("S16_audit_report", f"""SELECT fuente AS archivo, count(*) FILTER (seq % 6 <> 0) AS filas, count(DISTINCT modelo) FILTER (seq % 6 <> 0) AS modelos, count(*) FILTER (seq % 6 = 0) AS errores, {R('max(bytes) / 1024.0E0 / 1024 / 1024', 9)} AS gib FROM ({CAT}) c GROUP BY 1""")
def audit_report(spark, d):
    c = view(spark, d, S.CATALOG).withColumns({"archivo": F.col("fuente"), "modelo": F.when(F.col("seq") % 6 == 0, "ERROR").otherwise(F.col("modelo"))})
    return W.audit_report(c).withColumn("gib", rnd("gib", 9))


@query("S17_history_import", """SELECT s_suppkey AS run_id, s_acctbal AS best_fitness, 'antena' AS nota, false AS imported FROM supplier UNION ALL
SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_acctbal, 'sin nota', true FROM customer""")
def history_import(spark, d):
    h = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_acctbal").alias("best_fitness"), F.lit("antena").alias("nota"), F.lit(False).alias("imported"))
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("best_fitness"))
    return W.import_history(h, i, {"nota": "sin nota"})
