"""Readers, writers and incremental ingest: rows go to the shared scratch folder and are read back."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from thermal_lake.operators import catalog as K
from thermal_lake.operators import grid as GR
from thermal_lake.plans import correct as CO
from thermal_lake.plans import volume4d as V4
from thermal_lake.session import scratch_path
from thermal_lake.sources import readers as RD
from thermal_lake.sources import writers as WR
from thermal_lake.streaming import ingest as IN

from . import standins as S
from .core import R, query, rnd, sub, table, view
from .field_queries import FIELD, RAW, corrected, corrected_sql
from .grid_queries import _LINX, GRID
from .mesh_queries import FLAT
from .metadata_queries import _Q, CAT

DS = ["modelo", "dataset"]


@query("S1_read_datasets", f"""SELECT modelo, dataset, count(*) AS n, count(t_c) AS n_finite, {R('max(t_c)', 3)} AS t_max FROM (SELECT *, CASE WHEN sid % 3 = 0 THEN t_c + 1 ELSE t_c END AS tv FROM ({FIELD}) f WHERE sid % 2 = 0 OR sid % 3 = 0) g GROUP BY 1, 2""")
def read_datasets(spark, d):
    """Two roots that share datasets (the first wins) and a quarantine folder that is refused."""
    f = view(spark, d, S.FIELD_RAW).select(*DS, "sid", "point_id", *[F.col(a).cast("float").alias(a) for a in "xyz"], "t_idx", "t_min", F.col("t_raw").cast("float").alias("t_c"))
    root = scratch_path(spark, "s1")
    f.where("sid % 2 = 0").drop("sid").write.parquet(f"{root}/a")
    f.where("sid % 3 = 0").drop("sid").write.parquet(f"{root}/b")
    f.where("sid % 5 = 1").drop("sid").write.parquet(f"{root}/b/Repetidos")
    out = RD.read_datasets(spark, [f"{root}/a", f"{root}/b"])
    return out.groupBy(*DS).agg(F.count(F.lit(1)).alias("n"), F.count("t_c").alias("n_finite"), rnd(F.max("t_c").cast("double"), 3).alias("t_max"))


LISTING = f"SELECT ruta, bytes, mtime_days AS mtime, seq FROM ({S.CATALOG}) c"
_OK = f"""lower(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0)) LIKE '%.mat' AND NOT (starts_with(lower(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0)), 'indice_') OR contains(lower(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0)), 'historial')) AND NOT {_Q}"""


@query("S2_resolve_partitions", f"SELECT ruta, min(seq) AS seq FROM ({CAT}) c WHERE {_OK} AND seq % 3 = 0 GROUP BY 1")
def resolve_partitions(spark, d):
    c = view(spark, d, LISTING)
    return RD.resolve_partitions(c.where("seq % 3 = 0").select("ruta", "seq"), c)


@query("S2_fallback_scan", f"SELECT DISTINCT ruta, CAST(NULL AS BIGINT) AS seq FROM ({CAT}) c WHERE {_OK}")
def fallback_scan(spark, d):
    c = view(spark, d, LISTING)
    return RD.resolve_partitions(c.select(F.concat(F.lit("perdido/"), "ruta").alias("ruta"), "seq"), c)


@query("S3_light_inventory", f"""SELECT ruta, modelo, dataset, bytes, seq % 2 = 0 AS has_full_field, true AS has_probes, seq % 4 > 0 AS has_t_min FROM ({CAT}) c WHERE seq % 3 > 0
UNION ALL SELECT ruta, 'ERROR', NULL, bytes, NULL, NULL, NULL FROM ({CAT}) c WHERE seq % 3 = 0""")
def light_inventory(spark, d):
    c = view(spark, d, S.CATALOG)
    ok = c.where("seq % 3 > 0").withColumn("t_min", F.when(F.col("seq") % 4 > 0, 1.0))
    inv = RD.light_inventory(c.select("ruta", "bytes"), {"full_field": ok.where("seq % 2 = 0"), "probes": ok})
    return inv.select("ruta", "modelo", "dataset", "bytes", "has_full_field", "has_probes", "has_t_min")


@query("S4_most_recent", f"SELECT ruta FROM ({CAT}) c WHERE seq % 5 = 0 AND ruta IN (SELECT ruta FROM ({CAT}) e WHERE seq % 7 > 0) ORDER BY seq DESC LIMIT 1")
def most_recent(spark, d):
    c = view(spark, d, LISTING)
    return RD.most_recent(c.where("seq % 5 = 0"), c.where("seq % 7 > 0").select("ruta", "mtime"))


@query("S5_portable_paths", f"""SELECT seq, CASE WHEN seq % 3 = 0 THEN 'nuevo/raiz/' || CAST(seq AS VARCHAR) || '.mat' WHEN seq % 3 = 1 THEN 'viejo/datasets_masivos_por_metadata/' || CAST(seq AS VARCHAR) || '.mat' ELSE 'suelto/' || CAST(seq AS VARCHAR) || '.mat' END AS ruta FROM ({CAT}) c""")
def portable_paths(spark, d):
    c = view(spark, d, S.CATALOG).select("seq", F.concat(F.when(F.col("seq") % 3 < 2, "viejo/datasets_masivos_por_metadata/").otherwise("suelto/"), F.col("seq").cast("string"), F.lit(".mat")).alias("ruta"))
    return RD.repaired_index(c, c.where("seq % 3 = 1").select("ruta"), "nuevo/raiz/").select("seq", "ruta")


# One text per (user, day): at most a day of one user's events.
TEXTS = """SELECT user_id, day(ts) AS dia, concat('h', CAST(user_id AS STRING), '_', CAST(day(ts) AS STRING)) AS ruta, event_id, CAST(event_id - min(event_id) OVER (PARTITION BY user_id, day(ts)) AS BIGINT) AS rel, value FROM {events}"""


@query("S6_read_experiments", f"""WITH e AS ({sub(TEXTS)}), k AS (SELECT ruta, count(*) AS n FROM e GROUP BY 1), r AS (SELECT e.*, k.n, row_number() OVER (PARTITION BY e.ruta ORDER BY event_id) - 1 AS pos FROM e JOIN k USING (ruta))
SELECT ruta AS exp_id, CAST(p AS INT) AS probe_idx, 'P' || CAST(p AS VARCHAR) AS label, {R('CASE WHEN n >= 2 THEN rel / 60.0E0 ELSE pos / 60.0E0 END')} AS t_min, CASE WHEN n >= 2 THEN CASE p WHEN 1 THEN value ELSE CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 1 END END ELSE CASE p WHEN 1 THEN CAST(rel AS DOUBLE) WHEN 2 THEN value ELSE CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 1 END END END AS t_c
FROM r, (VALUES (1), (2), (3)) v(p) WHERE p <= CASE WHEN n >= 2 THEN 2 ELSE 3 END""")
def read_experiments(spark, d):
    line = F.concat_ws(";", F.col("rel").cast("string"), F.col("value").cast("string"), F.when(F.col("event_id") % 4 == 0, "NaN").otherwise((F.col("value") + 1).cast("string")))
    t = view(spark, d, TEXTS).groupBy("ruta").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("tiempo;a;b\n"), F.array_join(F.transform("ls", lambda v: v["l"]), "\n"), F.lit("\n;;\n"))
    return RD.parse_experiments(t.select("ruta", text.alias("texto"))).withColumn("t_min", rnd("t_min"))


@query("S6_experiments_by_line", f"""WITH e AS ({sub(TEXTS)}), k AS (SELECT ruta, count(*) AS n FROM e GROUP BY 1), r AS (SELECT e.*, k.n, row_number() OVER (PARTITION BY e.ruta ORDER BY event_id) - 1 AS pos FROM e JOIN k USING (ruta))
SELECT ruta AS exp_id, CAST(p AS INT) AS probe_idx, 'P' || CAST(p AS VARCHAR) AS label, {R('CASE WHEN n >= 2 THEN rel / 60.0E0 ELSE pos / 60.0E0 END')} AS t_min, CASE WHEN n >= 2 THEN CASE p WHEN 1 THEN value ELSE CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 1 END END ELSE CASE p WHEN 1 THEN CAST(rel AS DOUBLE) WHEN 2 THEN value ELSE CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 1 END END END AS t_c
FROM r, (VALUES (1), (2), (3)) v(p) WHERE p <= CASE WHEN n >= 2 THEN 2 ELSE 3 END""")
def read_experiments_by_line(spark, d):
    line = F.concat_ws(";", F.col("rel").cast("string"), F.col("value").cast("string"), F.when(F.col("event_id") % 4 == 0, "NaN").otherwise((F.col("value") + 1).cast("string")))
    t = view(spark, d, TEXTS).groupBy("ruta").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("tiempo;a;b\n"), F.array_join(F.transform("ls", lambda v: v["l"]), "\n"), F.lit("\n;;\n"))
    return RD.experiments_from_lines(RD.lines_of(t.select("ruta", text.alias("texto")))).withColumn("t_min", rnd("t_min"))


@query("S7_read_probe_logs", f"""SELECT ruta, CAST(p AS INT) AS probe_idx, CASE p WHEN 1 THEN 'S_1_a' ELSE 'Sonda_2' END AS label, {R('CAST(rel AS DOUBLE)')} AS t_min, CASE p WHEN 1 THEN value ELSE CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 1 END END AS t_c FROM ({sub(TEXTS)}) e, (VALUES (1), (2)) v(p)""")
def read_probe_logs(spark, d):
    line = F.concat_ws("\t", F.format_string("%.4f", F.col("rel").cast("double")), F.col("value").cast("string"), F.when(F.col("event_id") % 4 == 0, "NaN").otherwise((F.col("value") + 1).cast("string")))
    t = view(spark, d, TEXTS).groupBy("ruta").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("====\n 12 34 56\nModelo\nTiempo(min)\tS.1-a(C)\t(C)\n---------\n"), F.array_join(F.transform("ls", lambda v: v["l"]), "\n"), F.lit("\nfin\n"))
    return RD.parse_probe_logs(t.select("ruta", text.alias("texto"))).withColumn("t_min", rnd("t_min"))


@query("S7_probe_logs_by_line", f"""SELECT ruta, CAST(p AS INT) AS probe_idx, CASE p WHEN 1 THEN 'S_1_a' ELSE 'Sonda_2' END AS label, {R('CAST(rel AS DOUBLE)')} AS t_min, CASE p WHEN 1 THEN value ELSE CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 1 END END AS t_c FROM ({sub(TEXTS)}) e, (VALUES (1), (2)) v(p)""")
def read_probe_logs_by_line(spark, d):
    line = F.concat_ws("\t", F.format_string("%.4f", F.col("rel").cast("double")), F.col("value").cast("string"), F.when(F.col("event_id") % 4 == 0, "NaN").otherwise((F.col("value") + 1).cast("string")))
    t = view(spark, d, TEXTS).groupBy("ruta").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("====\n 12 34 56\nModelo\nTiempo(min)\tS.1-a(C)\t(C)\n---------\n"), F.array_join(F.transform("ls", lambda v: v["l"]), "\n"), F.lit("\nfin\n"))
    return RD.probe_logs_from_lines(RD.lines_of(t.select("ruta", text.alias("texto")))).withColumn("t_min", rnd("t_min"))


@query("S8_wide_probe_table", f"""SELECT modelo, dataset, printf('%.4f', t_min) AS "Tiempo(min)", {', '.join(f'''coalesce(printf('%.4f', max(t_c) FILTER (point_id = {p}) + 0.0000013), 'NaN') AS "S{p}(C)"''' for p in range(90))} FROM ({FIELD}) f GROUP BY modelo, dataset, t_min""")
def wide_probe_table(spark, d):
    p = view(spark, d, S.FIELD).select(*DS, F.concat(F.lit("S"), F.col("point_id").cast("string")).alias("probe"), "t_min", (F.col("t_c") + 0.0000013).alias("t_c"))
    root = scratch_path(spark, "s8")
    probes = [f"S{k}" for k in range(90)]
    WR.write_probe_tables(p, probes, root)
    return RD.read_probe_tables(spark, root, probes).select(*DS, "`Tiempo(min)`", *[f"`{p}(C)`" for p in probes])


@query("S9_read_binary_meshes", f"""SELECT CAST(mesh_id AS VARCHAR) AS mesh_id, facet_id, {R('CAST(CAST(x2 AS FLOAT) AS DOUBLE)', 5)} AS x2, {R('CAST(CAST(y3 AS FLOAT) AS DOUBLE)', 5)} AS y3, {R('CAST(CAST(z3 AS FLOAT) AS DOUBLE)', 5)} AS z3 FROM ({FLAT}) f""")
def read_binary_meshes(spark, d):
    flat = view(spark, d, S.FACET_FLAT)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("facet_id")
        body = b"".join(struct.pack("<12fH", 0, 0, 0, *row, 0) for row in pdf[["x1", "y1", "z1", "x2", "y2", "z2", "x3", "y3", "z3"]].itertuples(index=False))
        return pd.DataFrame({"mesh_id": [str(pdf["mesh_id"].iloc[0])], "content": [b"\0" * 80 + struct.pack("<I", len(pdf)) + body]})

    files = flat.groupBy("mesh_id").applyInPandas(pack, "mesh_id string, content binary")
    m = RD.decode_meshes(files, F.col("mesh_id"))
    return m.select("mesh_id", "facet_id", rnd("v2.x", 5).alias("x2"), rnd("v3.y", 5).alias("y3"), rnd("v3.z", 5).alias("z3"))


@query("S11_partitioned_writer", f"SELECT tipo, antena, CAST(caso AS INT) AS caso, potencia_w, count(*) AS n, CAST(sum(bytes + CASE WHEN tipo = 'Monopolo' AND antena = '2ant' THEN 1 ELSE 0 END) AS BIGINT) AS bytes FROM ({CAT}) c GROUP BY 1, 2, 3, 4")
def partitioned_writer(spark, d):
    """Writes every identity, then replaces only the folders of one type and layout."""
    c = view(spark, d, S.CATALOG).select("seq", "ruta", "bytes", "tipo", "antena", F.col("caso").cast("int").alias("caso"), "potencia_w")
    root = scratch_path(spark, "s11")
    WR.write_partitioned(c, root)
    WR.write_partitioned(c.where("tipo = 'Monopolo' AND antena = '2ant'").withColumn("bytes", F.col("bytes") + 1), root)
    back = spark.read.schema("seq long, ruta string, bytes long, tipo string, antena string, caso int, potencia_w double").parquet(root)
    return back.groupBy("tipo", "antena", "caso", "potencia_w").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query("S12_index_writer", f"SELECT t.seq, t.ruta, t.fuente, chunk, n, fuentes AS fuentes_equivalentes FROM (SELECT k, CAST(floor((rn - 1) / 3) AS BIGINT) AS chunk, count(*) AS n, string_agg(fuente, '|' ORDER BY rn) AS fuentes FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS rn FROM (SELECT lower(partition_key) AS k, fuente, min(seq) AS o FROM ({CAT}) c GROUP BY 1, 2) a) b GROUP BY 1, 2) l JOIN (SELECT *, row_number() OVER (PARTITION BY lower(partition_key) ORDER BY (lower(regexp_replace(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0), '\\.[^.]*$', '')) = regexp_replace(lower(partition_key), '_+', '_', 'g')) DESC, seq DESC) AS rn FROM ({CAT}) c) t ON k = lower(partition_key) WHERE rn = 1")
def index_writer(spark, d):
    c = view(spark, d, S.CATALOG)
    root = scratch_path(spark, "s12")
    WR.write_index(K.upsert_index(c.limit(0), c), K.alias_chunks(K.upsert_aliases(c.limit(0), c), 3), root)
    csv = spark.read.option("header", True).csv(f"{root}/csv").select(F.col("seq").cast("long").alias("seq"), "ruta", "fuente", F.lower("partition_key").alias("k"))
    aliases = spark.read.option("header", True).csv(f"{root}/aliases_csv").select(F.col("partition_key").alias("k"), F.col("chunk").cast("long").alias("chunk"), F.col("n").cast("long").alias("n"), "fuentes_equivalentes")
    return csv.join(spark.read.parquet(f"{root}/parquet").select("seq"), "seq", "left_semi").join(aliases, "k").drop("k")


@query("S13_corrected_writer", f"SELECT modelo, dataset, fecha, count(*) AS n, {R('max(CAST(CAST(t_corr AS FLOAT) AS DOUBLE))', 3)} AS t_max FROM (SELECT *, CASE WHEN sid % 2 = 0 THEN 'junio_1' ELSE 'mayo_2' END AS fecha FROM {corrected_sql()} q) t GROUP BY 1, 2, 3")
def corrected_writer(spark, d):
    out = corrected(spark, d)
    ident = view(spark, d, S.FIELD).select(*DS, "sid").distinct().select(*DS, F.when(F.col("sid") % 2 == 0, "junio_1").otherwise("mayo_2").alias("fecha"), F.lit("Zonas_4").alias("zonas"))
    root = scratch_path(spark, "s13")
    CO.export_corrected(out.select(*DS, "point_id", "t_idx", "t_corr"), ident, root, ("fecha", "zonas"))
    return spark.read.parquet(root).groupBy(*DS, "fecha").agg(F.count(F.lit(1)).alias("n"), rnd(F.max("t_corr").cast("double"), 3).alias("t_max"))


@query("S14_volume_export", f"""SELECT dataset, method, t_min, {R('n * 1.5E0')} AS volume FROM (SELECT dataset, 'fuente' AS method, t_min, count(*) FILTER (t_c >= 100) AS n FROM ({GRID}) g GROUP BY 1, 3 UNION ALL SELECT dataset, 'gradiente_local', t_min, count(*) FILTER (t_c >= 100) FROM {_LINX} l GROUP BY 1, 3) u""")
def volume_export(spark, d):
    g = view(spark, d, S.GRID)
    voxel = g.select("dataset").distinct().withColumn("voxel", F.lit(1.5))
    cols = ["dataset", *GR.VOXEL, "t_min", "method", "t_c", "sigma"]
    full = g.select("dataset", *GR.VOXEL, "t_min", F.lit(V4.ORIGINAL).alias("method"), "t_c", F.lit(None).cast("double").alias("sigma")).unionByName(
        GR.linear_trend(g, ["dataset"], 9.0).withColumn("method", F.lit("gradiente_local")).select(*cols))
    root = scratch_path(spark, "s14")
    WR.write_volume(full, V4.curves(full, ["dataset"], voxel, 100.0), root)
    return spark.read.parquet(f"{root}/volume_curve").select("dataset", "method", "t_min", rnd("volume").alias("volume"))


@query("T1_incremental_ingest", f"""WITH c AS (SELECT seq, ruta, fuente, lower(partition_key) AS k, bytes, seq % 2 AS batch, lower(regexp_replace(regexp_extract(replace(ruta, chr(92), '/'), '[^/]*$', 0), '\\.[^.]*$', '')) = regexp_replace(lower(partition_key), '_+', '_', 'g') AS canon FROM ({CAT}) q),
 a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY canon DESC, seq DESC) AS rn FROM c WHERE batch = 0), n AS (SELECT c.* FROM c LEFT JOIN a ON a.rn = 1 AND a.k = c.k AND a.fuente = c.fuente AND a.bytes = c.bytes WHERE c.batch = 1 AND a.k IS NULL),
 u AS (SELECT seq, ruta, fuente, k, canon, 0 AS side FROM a WHERE rn = 1 UNION ALL SELECT seq, ruta, fuente, k, canon, 1 FROM n) SELECT seq, ruta, fuente FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY canon DESC, side DESC, seq DESC) AS r FROM u) t WHERE r = 1""")
def incremental_ingest(spark, d):
    """Two arrivals, two runs of the same query, and a third run that finds nothing new."""
    c = view(spark, d, S.CATALOG).select("ruta", "fuente", "modelo", "dataset", "bytes", "seq")
    root = scratch_path(spark, "t1")
    for part in (0, 1, None):
        if part is not None:
            c.where(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        IN.ingest(spark, f"{root}/in", f"{root}/index", f"{root}/checkpoint", buckets=16).awaitTermination()
    return IN.current(spark, f"{root}/index").select("seq", "ruta", "fuente")
