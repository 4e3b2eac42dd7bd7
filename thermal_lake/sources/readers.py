"""Readers: stored tables, file listings, experiment and probe-log text, binary meshes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import metadata as M
from ..functions.nulls import enforce, extract, finite, text
from ..operators.catalog import first_per_key, portable_path
from ..operators.skew import ROWS_PER_RANGE, broadcast_if_small, ranked
from ..session import cut

# Rows of byte ranges or files that may be broadcast, some 100 bytes each.
RANGE_ROWS = 200_000


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One stored table with its fixed schema and the missing-value contract."""
    return enforce(spark.read.schema(schema).parquet(path))


def read_datasets(spark: SparkSession, roots: Sequence[str], schema: str = schemas.FIELD, partitions: str = "") -> DataFrame:
    """Thermal rows of several files or partition folders; the first root that has a dataset wins.

    ``partitions`` (DDL) names the folder columns of roots written by ``write_partitioned``: they become columns, and filters on
    them choose folders before a file is opened. Without it, all files below a root are read.

    Quarantined paths are refused by the path each row came from. With one root nothing is
    compared; with more, one small (dataset, root) table decides and rows are semi-joined to it.
    """
    def one(seq: int, root: str) -> DataFrame:
        if partitions:
            rows = spark.read.schema(f"{schema}, {partitions}").parquet(root)
        else:
            rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
        return rows.where(~M.quarantined(F.col("_metadata.file_path"))).withColumn("_root", F.lit(seq))

    parts = [one(i, r) for i, r in enumerate(roots)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if len(parts) > 1:
        owner = rows.groupBy("modelo", "dataset").agg(F.min("_root").alias("_root"))
        rows = rows.join(owner, ["modelo", "dataset", "_root"], "left_semi")
    return enforce(rows.drop("_root"))


def read_probe_tables(spark: SparkSession, path: str, probes: Sequence[str], keys: Sequence[str] = ("modelo", "dataset")) -> DataFrame:
    """The tables of ``write_probe_tables``, as text.

    Folders are listed in as many tasks as the session has use for, instead of one task a folder.
    """
    columns = [*[f"`{c}` string" for c in ("Tiempo(min)", *[f"{p}(C)" for p in probes])], *[f"`{k}` string" for k in keys]]
    setting, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(tasks, int(before))))
    try:
        return spark.read.option("sep", "\t").option("header", True).schema(", ".join(columns)).csv(path)
    finally:
        spark.conf.set(setting, before)


def listing(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Path, size and time of every file below ``root``; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(root).select(F.col("path").alias("ruta"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def resolve_partitions(index: DataFrame, found: DataFrame, extension: str = ".mat") -> DataFrame:
    """Existing, non-quarantined index entries, each once; the listing only if the index gives none.

    The choice is part of the plan: listing rows survive when no index row exists at all.
    """
    ok = found.where(M.eligible_file("ruta", extension))
    hit = index.join(ok.select("ruta").distinct(), "ruta", "left_semi")
    hit = first_per_key(hit.select("ruta", "seq"), ["ruta"])
    any_ = hit.limit(1).select(F.lit(True).alias("_any"))
    rest = ok.select("ruta").distinct().withColumn("_any", F.lit(True)).join(any_, "_any", "left_anti").drop("_any")
    return hit.select("ruta", "seq").unionByName(rest.withColumn("seq", F.lit(None).cast("long")))


def light_inventory(found: DataFrame, present: dict[str, DataFrame]) -> DataFrame:
    """S3: one row per (file, model, dataset) with presence flags; files without readable rows become ``ERROR``.

    ``present`` maps a flag name to rows (ruta, modelo, dataset, t_min); only key columns are read.
    """
    flags = list(present)
    rows = None
    for name, df in present.items():
        part = df.select("ruta", "modelo", "dataset", F.col("t_min").isNotNull().alias("_t"), *[F.lit(n == name).alias(n) for n in flags])
        rows = part if rows is None else rows.unionByName(part)
    inv = rows.groupBy("ruta", "modelo", "dataset").agg(*[F.max(n).alias(f"has_{n}") for n in flags], F.max("_t").alias("has_t_min"))
    good = found.join(inv, "ruta")
    bad = found.join(inv.select("ruta").distinct(), "ruta", "left_anti").withColumn("modelo", F.lit("ERROR"))
    out = good.unionByName(bad, allowMissingColumns=True)
    return M.with_identity(out.withColumn("_p", F.concat_ws("/", "ruta", "modelo", "dataset")), "_p").drop("_p")


def most_recent(index: DataFrame, found: DataFrame) -> DataFrame:
    """The last index entry that still exists, else the newest eligible file."""
    last = index.join(found.select("ruta").distinct(), "ruta", "left_semi").agg(F.max_by("ruta", "seq").alias("_i"))
    newest = found.where(M.eligible_file("ruta")).agg(F.max_by("ruta", F.struct("mtime", "ruta")).alias("_f"))
    one = lambda df: df.withColumn("_k", F.lit(0))
    return one(last).join(one(newest), "_k").select(F.coalesce("_i", "_f").alias("ruta"))


def repaired_index(index: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """Index whose missing paths are cut after the archive folder and put under ``root``."""
    have = found.select("ruta").distinct().withColumn("_hit", F.lit(True))
    j = index.join(have, "ruta", "left")
    return j.withColumn("ruta", portable_path(F.col("ruta"), root, F.coalesce("_hit", F.lit(False)))).drop("_hit")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(ruta, texto): one row per text file."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("ruta"), F.col("value").alias("texto"))


def _numbers(line: Column, separator: str) -> Column:
    return F.transform(F.split(F.trim(line), separator), lambda v: finite(F.trim(v).try_cast("double")))


def parse_experiments(texts: DataFrame, seconds: bool = True, separator: str = r"[,;\t]") -> DataFrame:
    """Long experiment rows from delimited text.

    Rows without any number are dropped. The first column is time if there are at least two
    columns and its numbers never decrease, otherwise time is the row position from 0.
    """
    rows = F.transform(F.split("texto", r"\r?\n"), lambda v: _numbers(v, separator))
    t = texts.select("ruta", F.filter(rows, lambda r: F.exists(r, lambda v: v.isNotNull())).alias("rows"))
    t = t.withColumn("heads", F.filter(F.transform("rows", lambda r: r[0]), lambda v: v.isNotNull()))
    n = F.size("heads")
    steps = F.zip_with(F.slice("heads", 1, n - 1), F.slice("heads", 2, n - 1), lambda a, b: b >= a)
    timed = (n >= 2) & (F.array_max(F.transform("rows", F.size)) >= 2) & F.forall(steps, lambda v: v)
    # Slices of length n - 1 need n >= 1; an empty file has no rows and leaves nothing.
    t = t.where(n >= 1).withColumn("timed", timed).select("ruta", "timed", F.posexplode("rows").alias("pos", "r"))
    scale = 60.0 if seconds else 1.0
    t = t.select("ruta", F.when(F.col("timed"), F.col("r")[0]).otherwise(F.col("pos").cast("double")).alias("t"),
                 F.when(F.col("timed"), F.slice("r", 2, F.greatest(F.lit(0), F.size("r") - 1))).otherwise(F.col("r")).alias("v"))
    t = t.where(F.col("t").isNotNull() & F.exists("v", lambda x: x.isNotNull()))
    return t.select("ruta", (F.col("t") / scale).alias("t_min"), F.posexplode("v").alias("k", "t_c")).select(
        F.col("ruta").alias("exp_id"), (F.col("k") + 1).alias("probe_idx"), F.concat(F.lit("P"), (F.col("k") + 1).cast("string")).alias("label"),
        "t_min", "t_c")


# The word that marks the table header of a probe log, and default probe names.
LOG_HEADER, LOG_PROBE = "Tiempo(min)", "Sonda_"


def parse_probe_logs(texts: DataFrame) -> DataFrame:
    """Long probe rows from log text: everything after the header line with at least two leading numbers."""
    t = texts.withColumn("lines", F.split("texto", r"\r?\n"))
    is_head = F.transform("lines", lambda v: v.contains(LOG_HEADER))
    t = t.withColumn("head", F.array_position(is_head, True).cast("int")).where("head > 0")
    t = t.withColumn("labels", _log_labels(F.element_at("lines", F.col("head"))))
    rest = F.slice("lines", F.col("head") + 1, F.size("lines"))
    return _log_rows(t.select("ruta", "labels", F.posexplode(F.filter(F.transform(rest, _leading), lambda r: F.size(r) >= 2)).alias("pos", "r")))


def _log_labels(head: Column) -> Column:
    """Probe names in a header line."""
    tokens = F.split(F.trim(head), r"\s+")
    clean = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\(.*?\)", ""), "[^a-zA-Z0-9_]", "_"), "_+", "_"), "^_|_$", "")
    return F.transform(F.slice(tokens, 2, F.greatest(F.lit(0), F.size(tokens) - 1)), lambda v, i: F.coalesce(text(clean(v)), F.concat(F.lit(LOG_PROBE), (i + 1).cast("string"))))


def _leading(line: Column) -> Column:
    """The numbers with which a line begins."""
    raw = F.transform(F.split(F.trim(line), r"\s+"), lambda v: v.try_cast("double"))
    bad = F.array_position(F.transform(raw, lambda v: v.isNull()), True).cast("int")
    return F.when(bad > 0, F.slice(raw, 1, bad - 1)).otherwise(raw)


def _log_rows(t: DataFrame) -> DataFrame:
    """Long rows of number lists ``r`` (time first) with the ``labels`` of their file."""
    own = F.size("labels") == F.size("r") - 1
    t = t.select("ruta", finite(F.col("r")[0]).alias("t_min"), "labels", own.alias("own"), F.posexplode(F.slice("r", 2, F.size("r") - 1)).alias("k", "v"))
    return t.select("ruta", (F.col("k") + 1).alias("probe_idx"), F.when(F.col("own"), F.try_element_at("labels", F.col("k") + 1)).otherwise(
        F.concat(F.lit(LOG_PROBE), (F.col("k") + 1).cast("string"))).alias("label"), "t_min", finite("v").alias("t_c"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ruta, line_no from 0, value) of text files that are read in byte ranges, so that one large file fills many tasks.

    Spark hands out the lines of a range in order; what a line's number needs besides is the number of lines in the ranges before, one
    small row a range. Nothing is sorted, no text is gathered.
    """
    own = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("ruta"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value")
    ranges = cut(own.groupBy("ruta", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("ruta").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = broadcast_if_small(ranges.withColumn("_before", before).drop("_n"), RANGE_ROWS)
    return own.join(at, ["ruta", "_start"]).select("ruta", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def lines_of(texts: DataFrame) -> DataFrame:
    """(ruta, line_no, value) of whole texts (ruta, texto)."""
    return texts.select("ruta", F.posexplode(F.split("texto", r"\r?\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


def experiments_from_lines(lines: DataFrame, seconds: bool = True, separator: str = r"[,;\t]", rows: int = ROWS_PER_RANGE) -> DataFrame:
    """S6 for files of any length, as :func:`parse_experiments`: rows are ranked and their order is tested range by range."""
    t = lines.withColumn("r", _numbers(F.col("value"), separator)).where(F.exists("r", lambda v: v.isNotNull())).select("ruta", "line_no", "r")
    t = ranked(t, ["ruta"], "line_no", name="pos", rows=rows).withColumn("pos", F.col("pos") - 1)
    t = t.withColumn("head", F.col("r")[0])
    # a file's order is tested in ranges of lines: inside each by its neighbours, across them by their ends
    span = t.where(F.col("head").isNotNull()).withColumn("_range", F.floor(F.col("line_no") / rows))
    w = Window.partitionBy("ruta", "_range").orderBy("line_no")
    parts = span.withColumn("_down", F.col("head") < F.lag("head").over(w)).groupBy("ruta", "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or("_down"), F.lit(False)).alias("_down"), F.min_by("head", "line_no").alias("_a"), F.max_by("head", "line_no").alias("_b"))
    parts = parts.withColumn("_down", F.col("_down") | F.coalesce(F.col("_a") < F.lag("_b").over(Window.partitionBy("ruta").orderBy("_range")), F.lit(False)))
    heads = parts.groupBy("ruta").agg(F.sum("_n").alias("_n"), F.bool_or("_down").alias("_down"))
    kinds = t.groupBy("ruta").agg(F.max(F.size("r")).alias("_width")).join(heads, "ruta").select("ruta", ((F.col("_n") >= 2) & (F.col("_width") >= 2) & ~F.col("_down")).alias("timed"))
    t = t.join(broadcast_if_small(cut(kinds), RANGE_ROWS), "ruta")
    timed = F.col("timed")
    t = t.select("ruta", F.when(timed, F.col("head")).otherwise(F.col("pos").cast("double")).alias("t"), F.when(timed, F.slice("r", 2, F.greatest(F.lit(0), F.size("r") - 1))).otherwise(F.col("r")).alias("v"))
    t = t.where(F.col("t").isNotNull() & F.exists("v", lambda x: x.isNotNull()))
    return t.select("ruta", (F.col("t") / (60.0 if seconds else 1.0)).alias("t_min"), F.posexplode("v").alias("k", "t_c")).select(
        F.col("ruta").alias("exp_id"), (F.col("k") + 1).alias("probe_idx"), F.concat(F.lit("P"), (F.col("k") + 1).cast("string")).alias("label"), "t_min", "t_c")


def probe_logs_from_lines(lines: DataFrame) -> DataFrame:
    """S7 for files of any length, as :func:`parse_probe_logs`: only header lines are gathered, one row a file."""
    is_head = F.col("value").contains(LOG_HEADER)
    heads = lines.where(is_head).groupBy("ruta").agg(F.min("line_no").alias("_from"), F.min_by("value", "line_no").alias("_head"))
    heads = broadcast_if_small(cut(heads.select("ruta", "_from", _log_labels(F.col("_head")).alias("labels"))), RANGE_ROWS)
    t = lines.join(heads, "ruta").where(F.col("line_no") > F.col("_from")).select("ruta", "labels", _leading(F.col("value")).alias("r")).where(F.size("r") >= 2)
    return _log_rows(t)


def read_experiments(spark: SparkSession, path: str, seconds: bool = True, separator: str = r"[,;\t]") -> DataFrame:
    """S6 over a folder, files of any length."""
    return experiments_from_lines(numbered_lines(spark, path), seconds, separator)


def read_probe_logs(spark: SparkSession, path: str) -> DataFrame:
    """S7 over a folder, files of any length."""
    return probe_logs_from_lines(numbered_lines(spark, path))


def decode_meshes(files: DataFrame, id_from: Column | None = None) -> DataFrame:
    """Facets of binary STL files (path, content): an 84-byte head, then 50 bytes per facet."""
    record = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mesh, raw in zip(pdf["mesh_id"], pdf["content"]):
                count = int(np.frombuffer(raw, "<u4", 1, 80)[0])
                v = np.frombuffer(raw, record, count, 84)["v"].astype(float).reshape(count, 9)
                out = pd.DataFrame(v, columns=[f"c{i}" for i in range(9)])
                out.insert(0, "facet_id", np.arange(count, dtype=np.int64))
                out.insert(0, "mesh_id", mesh)
                yield out

    name = id_from if id_from is not None else M.base_name("path")
    flat = files.select(name.alias("mesh_id"), "content").mapInPandas(
        decode, "mesh_id string, facet_id long, " + ", ".join(f"c{i} double" for i in range(9)))
    corner = lambda k: F.struct(*[F.col(f"c{3 * k + i}").alias(a) for i, a in enumerate("xyz")])
    return flat.select("mesh_id", "facet_id", corner(0).alias("v1"), corner(1).alias("v2"), corner(2).alias("v3"))


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """S9 over a folder of meshes; small files are packed into read tasks by size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.stl").option("recursiveFileLookup", "true").load(path)
    return decode_meshes(files)
