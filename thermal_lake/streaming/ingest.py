"""Incremental catalogue ingest into a bucketed, versioned index.

The index lies in buckets of the hashed key. A batch reads and rewrites only the buckets of its own keys, below a folder of
its version, and then writes a manifest, which says for every bucket which version holds it. Readers and the next batch go by
the newest manifest; a batch that is run again goes by the manifest before it, and so writes the same files once more. Files that
neither the newest manifest nor the one before it names are removed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import metadata as M
from ..functions.nulls import enforce
from ..operators import catalog as K
from ..session import cut

INCOMING = "ruta string, fuente string, modelo string, dataset string, bytes long, seq long"
ALIASES = "partition_key string, alias string, side int, seq long, pos int"
BUCKETS = 4096
TABLES = ("rows", "aliases")


def catalog_rows(batch: DataFrame) -> DataFrame:
    """Identity, key and signature of new files."""
    rows = M.with_identity(enforce(batch), "ruta")
    return rows.withColumns({
        "partition_key": M.partition_key(F.col("modelo"), F.col("dataset")),
        "signature": F.concat_ws("|", "fuente", F.col("bytes").cast("string"))})


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lower(key)), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, prefix: str, complete: bool = False) -> list[int]:
    """Numbers of the folders ``prefix``N below a path, those with a success mark if asked."""
    fs, p = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = [int(n[len(prefix):]) for n in names if n.startswith(prefix)]
    return sorted(n for n in found if not complete or fs.exists(_folder(spark, f"{path}/{prefix}{n}/_SUCCESS")[1]))


def manifest(spark: SparkSession, index: str, before: int | None = None) -> dict[int, int]:
    """Version of every bucket by the newest manifest (before a batch); empty at the start. At most one entry a bucket."""
    versions = [v for v in _numbers(spark, f"{index}/manifest", "v=", complete=True) if before is None or v < before]
    if not versions:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{index}/manifest/v={versions[-1]}").collect()}


def stored(spark: SparkSession, index: str, name: str, held: Mapping[int, int], schema) -> DataFrame:
    """Rows of the given buckets; no other bucket's files are opened."""
    fs = _folder(spark, index)[0]
    paths = [f"{index}/{name}/v={v}/bucket={b}" for b, v in sorted(held.items())]
    paths = [p for p in paths if fs.exists(_folder(spark, p)[1])]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, index: str, name: str = "rows", schema=None) -> DataFrame:
    """The whole index (or its ``aliases``) by the newest manifest."""
    held = manifest(spark, index)
    if schema is None:
        schema = ALIASES if name == "aliases" else catalog_rows(spark.createDataFrame([], INCOMING)).schema
    return stored(spark, index, name, held, schema)


def merge_batch(index: str, buckets: int = BUCKETS):
    """``foreachBatch`` body: skip current files, upsert the rest, write the touched buckets and the manifest.

    ``buckets`` must stay what it was when the index was begun.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(catalog_rows(batch).withColumn("bucket", bucket_of(F.col("partition_key"), buckets)))
        held = manifest(spark, index, batch_id)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
        mine = {b: held[b] for b in touched if b in held}
        fresh, schema = rows.drop("bucket"), rows.drop("bucket").schema
        old, known = stored(spark, index, "rows", mine, schema), stored(spark, index, "aliases", mine, ALIASES)
        fresh = K.not_current(fresh.withColumn("key", F.lower("partition_key")), old.select(F.lower("partition_key").alias("key"), "signature")).drop("key")
        met = K.upsert_aliases(fresh.limit(0), fresh).withColumn("side", F.lit(int(batch_id)))  # known ones have smaller numbers, so order is kept
        more = met.join(known.select("partition_key", "alias"), ["partition_key", "alias"], "left_anti")
        out = {"rows": K.upsert_index(old, fresh), "aliases": known.unionByName(more)}
        for name, df in out.items():
            part = df.withColumn("bucket", bucket_of(F.col("partition_key"), buckets))
            part.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{index}/{name}/v={batch_id}")
        now = {**held, **{b: int(batch_id) for b in touched}}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{index}/manifest/v={batch_id}")
        forget(spark, index, batch_id, held, now)

    return merge


def forget(spark: SparkSession, index: str, batch_id: int, held: Mapping[int, int], now: Mapping[int, int]) -> None:
    """Remove versions of buckets, and manifests, that neither this batch nor a second run of it needs."""
    needed = {(v, b) for m in (held, now) for b, v in m.items()}
    for name in TABLES:
        for v in _numbers(spark, f"{index}/{name}", "v="):
            if v < batch_id:
                own = _numbers(spark, f"{index}/{name}/v={v}", "bucket=")
                gone = [b for b in own if (v, b) not in needed]
                paths = [f"{index}/{name}/v={v}"] if len(gone) == len(own) else [f"{index}/{name}/v={v}/bucket={b}" for b in gone]
                for path in paths:
                    fs, p = _folder(spark, path)
                    fs.delete(p, True)
    for v in _numbers(spark, f"{index}/manifest", "v=", complete=True)[:-2]:
        fs, p = _folder(spark, f"{index}/manifest/v={v}")
        fs.delete(p, True)


def ingest(spark: SparkSession, incoming: str, index: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Take every listing file that has arrived since the last run, then stop."""
    stream = spark.readStream.schema(INCOMING).parquet(incoming)
    return stream.writeStream.foreachBatch(merge_batch(index, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
