"""Partition folders: filters choose folders, a large identity is written by several tasks, sources after the path are read."""

import glob

from pyspark.sql import functions as F

from thermal_lake.functions import metadata as M
from thermal_lake.sources import readers, writers


def test_partition_filters_and_large_identity(spark, tmp_path):
    root = str(tmp_path / "p")
    rows = spark.range(40_000).selectExpr("cast(if(id % 20 = 0, 'b', 'a') as string) AS tipo", "id AS n", "uuid() AS filler")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    try:
        writers.write_partitioned(rows, root, ["tipo"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len(glob.glob(f"{root}/tipo=a/*.parquet")) > 2
    back = readers.read_datasets(spark, [root], "n long, filler string", "tipo string").where("tipo = 'b'")
    assert back.count() == 2000
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_further_source_texts(spark):
    df = spark.createDataFrame([("datos/Monopolo/2ant", "correccion_junio_1_12p5min_prueba_3_zonas_4", ""), ("datos/x", None, "Un_slot/Caso_4/30W")], "ruta string, tag string, rel string")
    a, b = M.with_identity(df, "ruta", more=["tag", "rel"]).orderBy("ruta").collect()
    assert (a.tipo, a.num_antenas, a.fecha_adquisicion, a.tiempo_ejecucion_min, a.numero_prueba, a.num_zonas) == ("Monopolo", 2.0, "junio_1", 12.5, 3.0, 4.0)
    assert (b.tipo, b.caso, b.potencia_w, b.completa_simulacion) == ("Un_slot", 4.0, 30.0, False)


def test_base_model(spark):
    names = ["modelo_x_2ant__src_abc_r2", "modelo_x_2ant_pendientes", "modelo_x_2ant_R3", "a__src_b_c_r1", "m__SRC_b_pendientes", "r1"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    assert [r.b for r in df.select(M.base_model("m").alias("b")).collect()] == ["modelo_x_2ant", "modelo_x_2ant", "modelo_x_2ant", "a__src_b_c", "m__SRC_b", "r1"]
    assert df.select(F.count("*")).first()[0] == len(names)
