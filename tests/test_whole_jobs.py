"""Queries that an earlier change of their SQL had made smaller."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from registry import ORACLE, QUERIES
from thermal_lake.operators import catalog as K


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pending_points_take_every_order_and_its_first_entry(spark, tmp_path):
    n = 400
    pq.write_table(pa.table({"o_orderkey": pa.array([i * 3 % 997 for i in range(n)], pa.int64()), "o_custkey": pa.array([i % 20 for i in range(n)], pa.int64()),
                             "o_orderstatus": ["FOP"[i * i % 7 % 3] for i in range(n)], "o_orderpriority": [f"{i % 5 + 1}-X" for i in range(n)]}), f"{tmp_path}/orders.parquet")
    got = QUERIES["J15_pending_points"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    assert rows(got.select("modelo", "idx_caso", "p_ant")) == sorted(con.execute(ORACLE["J15_pending_points"]).fetchall(), key=str)
    entries = spark.createDataFrame([("m", 0, 10, "EN_CURSO", 1), ("m", 0, 10, "OK", 2), ("m", 0, 20, "OK", 3), ("m", 0, 20, "EN_CURSO", 4), ("m", 1, 10, "FALLO", 5), ("m", 1, 10, "CARBON_SOSTENIDA_MIN1", 6)],
                                    "modelo string, idx_caso int, p_ant int, estado string, seq long")
    assert rows(K.pending_points(entries, [0, 1], [10, 20], "seq")) == [("m", 0, 10), ("m", 1, 20)]
    assert rows(K.pending_points(entries, [0, 1], [10, 20])) == []


def test_the_index_names_all_sources_of_a_key(spark, tmp_path):
    n = 200
    pq.write_table(pa.table({"p_partkey": pa.array(range(1, n + 1), pa.int64()), "p_size": pa.array([i % 11 for i in range(n)], pa.int32()), "p_retailprice": [float(i) for i in range(n)]}), f"{tmp_path}/part.parquet")
    got = QUERIES["J12_index_upsert"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = con.execute(ORACLE["J12_index_upsert"]).fetchall()
    assert rows(got.select("seq", "ruta", "fuente", "clave", "fuentes_equivalentes")) == sorted(want, key=str)
    assert max(len(r[4].split("|")) for r in want) > 1


def test_aliases_of_all_chunks_stand_in_one_text(spark):
    aliases = spark.range(25).selectExpr("'k' AS partition_key", "concat('f', id) AS alias", "0 AS side", "id AS seq", "0 AS pos")
    index = spark.createDataFrame([("K", 1), ("none", 2)], "partition_key string, seq int")
    got = {r.seq: r.fuentes_equivalentes for r in K.with_aliases(index, K.alias_chunks(aliases, 4)).collect()}
    assert got == {1: "|".join(f"f{i}" for i in range(25)), 2: None}
