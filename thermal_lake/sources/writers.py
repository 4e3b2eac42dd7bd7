"""Writers: partitioned data, index, probe tables, volume results, correction store, reports, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import same
from ..operators.catalog import append_filled, number_revisions
from ..operators.skew import spread
from ..schemas import PARTITIONS


def wide_probe_table(series: DataFrame, probes: Sequence[str], keys: Sequence[str] = ("modelo", "dataset")) -> DataFrame:
    """Time x probe with four decimals and ``NaN`` for gaps; the probe list fixes the columns."""
    wide = series.groupBy(*keys, "t_min").pivot("probe", list(probes)).agg(F.first("t_c", ignorenulls=True))
    four = lambda c: F.when(c.isNull(), "NaN").otherwise(F.format_string("%.4f", c))
    return wide.select(*keys, four(F.col("t_min")).alias("Tiempo(min)"), *[four(F.col(f"`{p}`")).alias(f"{p}(C)") for p in probes])


def write_probe_tables(series: DataFrame, probes: Sequence[str], path: str, keys: Sequence[str] = ("modelo", "dataset")) -> None:
    """One folder per dataset, tab separated, rows in time order inside each file."""
    table = wide_probe_table(series, probes, keys)
    # What a task costs here is its files, not its bytes: the datasets are dealt out to a fixed number of tasks.
    spread(table, *keys).sortWithinPartitions(*keys, F.col("`Tiempo(min)`").cast("double")).write.mode("overwrite").partitionBy(*keys).option(
        "sep", "\t").option("header", True).csv(path)


def probe_header(probes: DataFrame, keys: Sequence[str] = ("modelo", "dataset")) -> DataFrame:
    """One header line per probe with requested and real coordinates."""
    at = lambda s: F.format_string("[%6.2f, %6.2f, %6.2f]", F.col(f"{s}.x"), F.col(f"{s}.y"), F.col(f"{s}.z"))
    return probes.select(*keys, "probe", F.concat(F.lit("Sonda "), F.rpad("probe", 12, " "), F.lit(" Pedida: "), at("coord_mm"), F.lit(" mm | Real: "),
                                                  at("coord_real"), F.lit(" mm (In_Domain="), F.col("in_domain").cast("int").cast("string"), F.lit(")")).alias("linea"))


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """One folder per identity; only folders present in ``df`` are replaced.

    Rows are clustered by the partition columns so that a folder gets few files. The rebalance hint lets the adaptive planner split
    an identity by the bytes it turns out to have, so a very large one is written by many tasks.
    """
    df.hint("rebalance", *partitions).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_index(catalog: DataFrame, aliases: DataFrame, path: str) -> None:
    """The index, and the alias lists of its keys in chunks, as tables and as quoted CSV with a header."""
    for name, df in (("", catalog), ("aliases_", aliases)):
        df.write.mode("overwrite").parquet(f"{path}/{name}parquet")
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{path}/{name}csv")


def write_volume(grid: DataFrame, curve: DataFrame, path: str) -> None:
    """Field and volume curves, by method."""
    grid.write.mode("overwrite").partitionBy("method").parquet(f"{path}/grid_field")
    curve.write.mode("overwrite").partitionBy("method").parquet(f"{path}/volume_curve")


def classify_corrections(incoming: DataFrame, stored: DataFrame, content: Sequence[str], seq: str = "seq") -> DataFrame:
    """``principal`` for a new path, else ``equivalentes`` or ``conflictos`` with a revision from 2.

    Content is compared column by column, missing values agreeing, with the principal stored
    under the same path.
    """
    main = stored.where("category = 'principal'").select("path", *[F.col(c).alias(f"_s_{c}") for c in content], F.lit(True).alias("_have"))
    equal = F.lit(True)
    for c in content:
        equal = equal & same(F.col(c), F.col(f"_s_{c}"))
    j = incoming.join(main, "path", "left").withColumn("category", F.when(F.col("_have").isNull(), "principal").when(equal, "equivalentes").otherwise("conflictos"))
    j = j.drop("_have", *[f"_s_{c}" for c in content])
    fresh = j.where("category = 'principal'").withColumn("revision", F.lit(1).cast("long"))
    again = number_revisions(j.where("category != 'principal'"), stored.where("category != 'principal'").select("path", "category", "revision"), ["path", "category"], seq)
    return fresh.unionByName(again)


def audit_report(inventory: DataFrame) -> DataFrame:
    """Per file its models, datasets, size and errors."""
    return inventory.groupBy("archivo").agg(
        F.count_if(F.col("modelo") != "ERROR").alias("filas"), F.count_distinct(F.when(F.col("modelo") != "ERROR", F.col("modelo"))).alias("modelos"),
        F.count_if(F.col("modelo") == "ERROR").alias("errores"), (F.max("bytes") / 1024**3).alias("gib"))


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as CSV."""
    report.write.mode("overwrite").option("header", True).csv(path)


def import_history(history: DataFrame, imported: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Imported runs get ids after the largest known one; missing fields take defaults."""
    from ..operators.skew import ranked
    top = history.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("_top")).withColumn("_k", F.lit(0))
    new = ranked(imported.withColumn("_k", F.lit(0)), ["_k"], "run_id", name="_rn").join(top, "_k")
    new = new.withColumn("run_id", (F.col("_top") + F.col("_rn")).cast("long")).drop("_k", "_top", "_rn").withColumn("imported", F.lit(True))
    return append_filled(history, new, defaults)
