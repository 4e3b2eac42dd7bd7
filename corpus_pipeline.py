"""The corpus pipeline: filters and encodes the table ``documents``, stage by stage.

Cases, for every stage: an empty table gives an empty one. Null or empty texts have no words, so the first stage removes them; given to a later
stage, they are in no group, hold no item and no secret, and have no ids. Rows without doc_id are judged by their own text and never grouped. Repeated
rows, and rows that share a doc_id, count as copies in the second stage, which keeps one of them (the smallest row); the other
stages treat each row by itself. Columns beyond those of ``documents`` are left out by the first stage. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake.llm import bpe, decontamination, jaccard_join, quality_rules, secrets
from thermal_lake.llm.common import bounded, table
from thermal_lake.llm.queries import vocabulary
from thermal_lake.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified rules reject go."""
    bounded(spark)
    measured = quality_rules.measure(docs, COLUMNS)
    cutoffs = quality_rules.fit(quality_rules.measure(docs, ["doc_id", "lang"]), table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).where(F.col("kept")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, Jaccard similarity of 0.8 or more, linked transitively."""
    bounded(spark)
    return jaccard_join.one_of_each(docs, k=5, threshold=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its error budget, go."""
    bounded(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[SECRET]``; n_chars follows."""
    bounded(spark)
    return secrets.redact(docs, size="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and checksums of ids and decoded text."""
    bounded(spark)
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret scans", secret_scans),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
