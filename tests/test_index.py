"""The index: long alias store, buckets that a batch touches, replay."""

import os
from functools import reduce

from pyspark.sql import functions as F

from thermal_lake.operators import catalog as K
from thermal_lake.session import scratch_path
from thermal_lake.streaming import ingest as IN


def listing(spark, first, last, keys, shift=0):
    return spark.range(first, last).select(
        F.concat(F.lit("datos/Monopolo/2ant/Caso_1/Potencia_20W/f"), F.col("id").cast("string"), F.lit(".mat")).alias("ruta"), F.concat(F.lit("fuente_"), F.col("id").cast("string")).alias("fuente"),
        F.concat(F.lit("modelo_"), (F.col("id") % keys).cast("string")).alias("modelo"), F.lit("d").alias("dataset"), (F.col("id") + shift).alias("bytes"), F.col("id").alias("seq"))


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_touches_its_buckets_only(spark):
    root = scratch_path(spark, "index")
    merge = IN.merge_batch(root, 512)
    merge(listing(spark, 0, 20_000, 10_000).coalesce(2), 0)
    local = root.removeprefix("file://")
    before = {f: os.path.getsize(f) for f in files(f"{local}/rows")}
    batch = listing(spark, 20_000, 20_010, 10**6).coalesce(1).unionByName(listing(spark, 5, 6, 10_000))  # ten new keys, and one file that is known
    merge(batch, 1)
    written = {f: os.path.getsize(f) for f in files(f"{local}/rows/v=1")}
    held = IN.manifest(spark, root)
    assert sum(v == 1 for v in held.values()) <= 11 and len(held) == 512
    assert sum(written.values()) < 0.05 * sum(before.values())  # 11 of 512 buckets
    assert IN.current(spark, root).count() == 10_010
    one = rows(IN.current(spark, root)), rows(IN.current(spark, root, "aliases"))
    merge(batch, 1)  # the same batch once more
    assert one == (rows(IN.current(spark, root)), rows(IN.current(spark, root, "aliases")))
    merge(listing(spark, 20_000, 20_010, 10**6, shift=1), 2)
    merge(listing(spark, 20_000, 20_010, 10**6, shift=2), 3)
    assert not {f for f in files(f"{local}/rows") if "/v=1/" in f and int(f.split("bucket=")[1].split("/")[0]) in {b for b, v in IN.manifest(spark, root).items() if v == 3}}
    assert IN._numbers(spark, f"{root}/manifest", "v=") == [2, 3]
    assert IN.current(spark, root).where("seq >= 20000").agg(F.sum(F.col("bytes") - F.col("seq"))).first()[0] == 20


def test_index_equals_one_upsert_of_everything(spark):
    root = scratch_path(spark, "index")
    parts = [listing(spark, 40 * i, 40 * i + 40, 7).withColumn("modelo", F.when(F.col("seq") % 3 == 0, F.upper("modelo")).otherwise(F.col("modelo"))) for i in range(3)]
    for i, p in enumerate(parts):
        IN.merge_batch(root, 4)(p, i)
    every = IN.catalog_rows(reduce(lambda a, b: a.unionByName(b), parts))
    assert rows(IN.current(spark, root).select("seq", "ruta")) == rows(K.upsert_index(every.limit(0), every).select("seq", "ruta"))
    aliases = IN.current(spark, root, "aliases")
    assert aliases.count() == 120
    text = {(r.partition_key, r.chunk): r.fuentes_equivalentes for r in K.alias_chunks(aliases, 8).collect()}
    assert text["modelo_3__d", 0] == "|".join(f"fuente_{i}" for i in range(3, 59, 7)) and text["modelo_3__d", 2] == "fuente_115"
    empty = scratch_path(spark, "index")
    assert IN.current(spark, empty).count() == 0 and IN.manifest(spark, empty) == {}


def test_aliases_of_a_hot_key_lie_in_many_rows(spark):
    df = spark.range(30_000).select(F.lit("Hot").alias("partition_key"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("ruta"), F.concat(F.lit("f"), (F.col("id") % 20_000).cast("string")).alias("fuente"),
                                    F.lit("m").alias("modelo"), F.lit("d").alias("dataset"), (30_000 - F.col("id")).alias("seq"))
    new = K.alias_chunks(K.upsert_aliases(df.limit(0), df), 1000, rows=2500)
    assert new.count() == 20 and new.agg(F.max("n"), F.sum("n")).first() == (1000, 20_000)
    assert new.where("chunk = 0").first().fuentes_equivalentes.startswith("f9999|f9998|") and new.where("chunk = 19").first().fuentes_equivalentes.endswith("|f10000")
    listed = spark.createDataFrame([("k", "r", "b", "m", "d", 2, "a||c|a"), ("K", "r2", "c", "m", "d", 1, None), ("k", "r3", None, "m", "d", 0, "z")], "partition_key string, ruta string, fuente string, modelo string, dataset string, seq long, fuentes_equivalentes string")
    assert [tuple(r) for r in K.alias_chunks(K.upsert_aliases(listed.limit(0), listed)).collect()] == [("k", 0, 3, "c|a|b")]
