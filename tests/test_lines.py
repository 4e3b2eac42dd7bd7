"""Text files read in byte ranges: line numbers, and the same rows as from whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from thermal_lake.sources import readers as RD


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_across_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    want = {}
    for name in ("a", "b", "c"):
        lines = ["x" * rng.randint(0, 80) + str(i) for i in range(rng.choice([3, 900, 1500]))]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + ("\n" if name == "a" else ""))
        want |= {(name, i): v for i, v in enumerate(lines)}
    df = RD.numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    assert {(r.ruta.rsplit("/", 1)[1][:-4], r.line_no): r.value for r in df.collect()} == want


def texts(rng):
    head = "Modelo\n 1 2 3\nTiempo(min)\tS.1-a(C)\t(C)\n-----\n"
    log = lambda n: head + "\n".join(f" {i}.5\t{rng.random():.3f}\t{rng.choice(['NaN', '7', '8.25'])}{rng.choice(['', ' fin'])}" for i in range(n)) + "\nfin\n5\n"
    table = lambda n, down: "t;a;b\n" + "\n".join(f"{i if i != down else -1};{rng.random():.3f};{rng.choice(['', 'NaN', '3'])}" for i in range(n)) + "\n;;\n"
    return {"l1": log(400), "l2": log(0), "l3": "nothing\n1 2\n", "e1": table(300, None), "e2": table(300, 250), "e3": "1\n2\nx\n0", "e4": "5;6", "e5": "", "e6": "a;b\n;\n", "e7": "1;NaN\n0;3\nx;4"}


def test_whole_texts_and_lines_agree(spark, tmp_path, small_ranges):
    made = texts(random.Random(3))
    for name, t in made.items():
        (tmp_path / f"{name}.txt").write_text(t)
    whole = spark.createDataFrame(list(made.items()), "ruta string, texto string")
    name = lambda c: F.regexp_extract(c, r"([^/.]+)(?:\.txt)?$", 1)
    rows = lambda df, c: sorted((tuple(r) for r in df.withColumn(c, name(c)).collect()), key=str)
    assert rows(RD.parse_probe_logs(whole), "ruta") == rows(RD.read_probe_logs(spark, str(tmp_path)), "ruta") != []
    want = rows(RD.parse_experiments(whole), "exp_id")
    assert want == rows(RD.read_experiments(spark, str(tmp_path)), "exp_id") != []
    assert want == rows(RD.experiments_from_lines(RD.lines_of(whole), rows=7), "exp_id")  # order tested and ranked in ranges of seven lines
