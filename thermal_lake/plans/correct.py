"""Mass correction: every correction on every compatible dataset as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import field as FL
from ..operators.catalog import match_corrections, not_current
from ..operators.skew import broadcast_if_small
from ..sources.writers import write_partitioned

# A pair is two names and an id (about 100 bytes): at most some tens of MB.
PAIR_BROADCAST_ROWS = 200_000


def correct_field(field: DataFrame, pairs: DataFrame, zones: DataFrame, knots: DataFrame, instants: DataFrame | None = None,
                  ssa: DataFrame | None = None, intensity: float = 1.0, apply_offset: bool = True, cap_c: float | None = None) -> DataFrame:
    """C1 over many datasets: field rows of ``pairs`` (modelo, dataset, corr_id) with ``t_base`` and ``t_corr``.

    Datasets without a pair are left out first; the rest is shuffled once, by point, for its base value. Everything joined to it (pairs and
    band plans) is a per-dataset or per-correction table, broadcast after its rows were counted;
    larger ones are joined by key and the adaptive planner splits a dataset that dominates.
    """
    field = field.join(pairs.select("modelo", "dataset").distinct(), ["modelo", "dataset"], "left_semi")
    base = FL.first_temperature(field)
    inst = instants if instants is not None else field.select("modelo", "dataset", "t_min").distinct()
    need = pairs.join(inst, ["modelo", "dataset"]).select("corr_id", "t_min").distinct()
    plan = FL.zone_plan(zones, FL.factor_table(zones, knots, need, ssa), intensity, apply_offset, cap_c)
    near = broadcast_if_small(pairs, PAIR_BROADCAST_ROWS)
    return FL.correct(base.join(near, ["modelo", "dataset"]), plan, ["corr_id", "t_min"])


def correct_probes(series: DataFrame, pairs: DataFrame, zones: DataFrame, knots: DataFrame, **options) -> DataFrame:
    """Probe curves corrected at the depth of the probe, originals kept as ``t_c_original``.

    ``series`` holds (modelo, dataset, probe, z, t_idx, t_min, t_c); a probe without a known depth
    (z NULL) is outside every bounded band.
    """
    s = series.withColumn("point_id", F.col("probe"))
    out = correct_field(s, pairs, zones, knots, **options)
    return out.withColumnRenamed("t_c", "t_c_original").withColumnRenamed("t_corr", "t_c").drop("point_id")


def correct_snapshots(points: DataFrame, pairs: DataFrame, zones: DataFrame, knots: DataFrame, **options) -> DataFrame:
    """C2 without a full field: the base of a snapshot is the temperature of its first point."""
    first = points.groupBy("modelo", "dataset", "t_idx").agg(F.min_by("t_c", "point_id").alias("t_base"))
    inst = points.select("modelo", "dataset", "t_min").distinct()
    need = pairs.join(inst, ["modelo", "dataset"]).select("corr_id", "t_min").distinct()
    ssa = options.pop("ssa", None)
    plan = FL.zone_plan(zones, FL.factor_table(zones, knots, need, ssa), **options)
    j = points.join(first, ["modelo", "dataset", "t_idx"]).join(pairs, ["modelo", "dataset"])
    return FL.correct(j, plan, ["corr_id", "t_min"])


def mass_correction(catalog: DataFrame, corrections: DataFrame, done: DataFrame, field: DataFrame, zones: DataFrame,
                    knots: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corrected field, pairs done now, corrections without any compatible dataset).

    Pairs whose stored signature is current are skipped before any field row is read.
    """
    pairs = match_corrections(catalog, corrections.where("complete") if "complete" in corrections.columns else corrections)
    keyed = pairs.select("modelo", "dataset", "corr_id", F.concat_ws("|", "partition_key", F.col("corr_id").cast("string")).alias("key"))
    sign = corrections.select("corr_id", "signature")
    todo = not_current(keyed.join(sign, "corr_id"), done)
    lonely = corrections.join(pairs.select("corr_id").distinct(), "corr_id", "left_anti")
    todo_pairs = todo.select("modelo", "dataset", "corr_id").distinct()
    return correct_field(field, todo_pairs, zones, knots, **options), todo, lonely


def export_corrected(corrected: DataFrame, identity: DataFrame, path: str, partitions: tuple[str, ...]) -> None:
    """Corrected rows with their identity columns, written by identity and acquisition."""
    out = corrected.join(identity, ["modelo", "dataset"]).withColumn("t_corr", F.col("t_corr").cast("float"))
    write_partitioned(out, path, partitions)
