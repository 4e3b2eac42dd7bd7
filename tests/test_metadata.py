"""Identity cases: paths, tags, keys, revisions."""

import pytest
from pyspark.sql import functions as F

from thermal_lake.functions import metadata as M
from thermal_lake.functions import textfmt as X
from thermal_lake.sources import writers as W


def parse(spark, *paths):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, ruta string")
    return [r.asDict() for r in M.with_identity(df).orderBy("i").collect()]


def test_canonical_corrected_path(spark):
    r, = parse(spark, "Monopolo/1ant/Caso_1/Potencia_30W/Fecha_junio_19/Tiempo_20min/Prueba_1/Zonas_4/Geometria_Ablacion_t5.0000min.stl")
    assert (r["tipo"], r["antena"], r["caso"], r["potencia_w"]) == ("Monopolo", "1ant", 1.0, 30.0)
    assert (r["fecha_adquisicion"], r["tiempo_ejecucion_min"], r["numero_prueba"], r["num_zonas"]) == ("junio_19", 20.0, 1.0, 4.0)
    assert r["completa_simulacion"] and r["completa_adquisicion"]


def test_tag_carries_the_test_number(spark):
    r, = parse(spark, "x/correccion_junio_19_20min_prueba_2_zonas_4/a.mat")
    assert r["numero_prueba"] == 2.0 and r["fecha_adquisicion"] == "junio_19" and not r["completa_simulacion"]


def test_words_and_decimal_mark(spark):
    a, b = parse(spark, "exp/tres antenas/Segundo experimento/x.csv", "un_slot\\2ant\\Caso_3\\Potencia_12p5W\\x.mat")
    assert a["num_antenas"] == 3.0 and a["numero_prueba"] == 2.0
    assert (b["tipo"], b["num_antenas"], b["caso"], b["potencia_w"]) == ("Un_slot", 2.0, 3.0, 12.5)


def test_explicit_values_win(spark):
    df = spark.createDataFrame([("Monopolo/1ant/Caso_1/Potencia_30W/a", "Un_slot", float("nan"), 7.0)], "ruta string, t string, c double, idx double")
    r = M.with_identity(df, "ruta", {"tipo": "t", "caso": "c", "idx_caso": "idx"}).first()
    assert r.tipo == "Un_slot" and r.caso == 1.0


def test_paths_of_different_dates_differ(spark):
    df = spark.createDataFrame([("junio_19",), ("junio_22",)], "f string")
    p = [r.p for r in df.select(M.acquisition_folder(F.col("f"), F.lit(20.0), F.lit(1.0), F.lit(4.0)).alias("p")).collect()]
    assert p[0] == "Fecha_junio_19/Tiempo_20min/Prueba_1/Zonas_4" and p[0] != p[1]


@pytest.mark.parametrize("value,text", [(30.0, "30"), (2.5, "2.5"), (0.0001, "0.0001"), (1234567.0, "1.23457e+06"), (-12.25, "-12.25"), (0.0, "0"), (1e-5, "1e-05")])
def test_general_format(spark, value, text):
    assert spark.range(1).select(X.g(F.lit(value)).alias("t")).first().t == text == f"{value:g}"


def test_short_tag(spark):
    df = spark.createDataFrame([("corr_4 antenas_30 watt 15min zonas4_2",), ("Fecha_a_4ant_30w_15min",), ("corr_solo nombre",), ("",)], "s string")
    assert [r.t for r in df.select(X.short_correction_tag("s").alias("t")).collect()] == ["4ant_30w_15min_z4_r2", "4ant_30w_15min", "solo_nombre", "correccion"]


def test_revisions(spark):
    stored = spark.createDataFrame([("p", 1.0, "principal", 1)], "path string, v double, category string, revision long")
    inc = spark.createDataFrame([(1, "p", 1.0), (2, "p", 2.0), (3, "p", 3.0), (4, "q", None)], "seq int, path string, v double")
    got = {r.seq: (r.category, r.revision) for r in W.classify_corrections(inc, stored, ["v"]).collect()}
    assert got == {1: ("equivalentes", 2), 2: ("conflictos", 2), 3: ("conflictos", 3), 4: ("principal", 1)}


def test_catalogues_deal_out_paths_and_parse_them_once(spark):
    from thermal_lake.operators import catalog as K

    path = "datos/Monopolo/2ant/Caso_3/Potencia_12p5W/correccion_junio_4_5min_prueba_2_zonas_4/archivo_{}.mat"
    rows = [(k, path.format(k)) for k in range(50)] + [(60, "otros/sin_identidad.txt"), (61, None), (62, path.format(1))]
    files = spark.createDataFrame(rows, "seq long, ruta string").coalesce(1)
    found = K.correction_catalog(files)
    assert found.rdd.getNumPartitions() > 1  # one file split is dealt out to all tasks
    assert sorted(r.seq for r in found.collect()) == [*range(50), 62]
    for made in (found, K.distribution_catalog(files)):
        before, dealt = made._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)
        assert dealt.count("split(") < 5  # no parsing before the paths are dealt out
        assert before.count("split(") < 150  # 208 and 304 where a filter repeats the identity
    assert {(r.tipo, r.caso, r.potencia, r.fecha, r.zonas, r.origen) for r in K.distribution_catalog(files).collect()} == {("Monopolo", "3", "Potencia_12p5W", "junio_4", "4", "corregido")}
