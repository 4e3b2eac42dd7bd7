"""Checks that produce the first failing reason of a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .field import DATASET

TOL = 1e-9


def close(a: Column, b: Column | float) -> Column:
    """Equal within 1e-9; missing never agrees."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.coalesce(F.abs(a - b) <= TOL, F.lit(False))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Text of the first check that fails; NULL when none does."""
    return F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in checks])


def field_summary(field: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """Counts that V1c and V2c need, from one pass.

    Points per instant are counted first (small), so no distinct set of points is held: a field is
    complete when every instant has the same number of rows as the largest one.
    """
    per = field.groupBy(*keys, "t_idx").agg(F.count(F.lit(1)).alias("n"), F.count("t_c").alias("v"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ff_instants"), F.min("n").alias("ff_min"), F.max("n").alias("ff_max"), F.sum("v").alias("ff_values"))


def field_reason(n_t: Column) -> Column:
    """V2c over the columns of ``field_summary``; ``n_t`` is the length of the time vector."""
    return first_reason(
        (F.col("ff_instants").isNull() | (F.col("ff_max") == 0), "full_field vacio"),
        ((F.col("ff_min") != F.col("ff_max")) | (F.col("ff_instants") != n_t), "full_field no coincide con puntos/tiempos"),
        (F.col("ff_values") == 0, "full_field sin temperaturas finitas"))


def probe_summary(probes: DataFrame, n_t: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """V3c per dataset: number of probes, of those with a wrong length and of those with gaps."""
    per = probes.groupBy(*keys, "probe").agg(F.count(F.lit(1)).alias("n"), F.count("t_c").alias("v"), F.count("t_min").alias("t"))
    j = per.join(n_t, list(keys))
    wrong = (F.col("n") != F.col("n_t")) | (F.col("t") != F.col("n_t"))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_probes"), F.count_if(wrong).alias("probes_wrong"),
        F.count_if(~wrong & (F.col("v") < F.col("n"))).alias("probes_gaps"))


def probe_reason() -> Column:
    return first_reason(
        (F.coalesce(F.col("n_probes"), F.lit(0)) == 0, "sin sondas extraidas"),
        (F.col("probes_wrong") > 0, "sonda no coincide con tiempos"),
        (F.col("probes_gaps") > 0, "sonda contiene NaN/Inf"))


def domain_differs(enabled: Column, z0: Column, z1: Column, radius: Column, config: Mapping[str, object]) -> Column:
    """Stored extraction domain against the current one."""
    return ~(F.coalesce(enabled == F.lit(bool(config["enabled"])), F.lit(False)) & close(z0, float(config["z_min_mm"]))
             & close(z1, float(config["z_max_mm"])) & close(radius, float(config["radius_mm"])))


def config_reason(config: Mapping[str, object]) -> Column:
    """V4c over the columns of the dataset metadata."""
    return first_reason(
        (~F.coalesce(F.col("full_field_available"), F.lit(False)), "metadata sin full_field disponible"),
        (~close(F.col("n_grid").cast("double"), float(config["n_grid"])), "resolucion de grilla distinta a la configuracion actual"),
        (~close(F.col("t_abl"), float(config["t_abl"])), "umbral de ablacion distinto a la configuracion actual"),
        (~close(F.col("t_carbon"), float(config["t_carbon"])), "umbral de carbonizacion distinto a la configuracion actual"),
        (domain_differs(F.col("dom_enabled"), F.col("dom_z0"), F.col("dom_z1"), F.col("dom_r"), config),
         "dominio de extraccion distinto a la configuracion actual"))


def record_reason(n_t: Column, finite_times: Column, n_snapshots: Column, config: Mapping[str, object]) -> Column:
    """Times, snapshots, field, probes and configuration, in that order."""
    return F.coalesce(
        first_reason((F.coalesce(n_t, F.lit(0)) == 0, "vector temporal invalido"), (finite_times != n_t, "vector temporal invalido"),
                     (n_snapshots != n_t, "numero de snapshots distinto al vector temporal")),
        field_reason(n_t), probe_reason(), config_reason(config))


def single_antenna_reason(probes: DataFrame, meta: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """V5c for one-antenna models: shift recorded, probes at the shifted X and Y, in domain, without gaps.

    ``probes`` holds (keys, probe, x, y, in_domain, n, n_finite); ``meta`` (keys, model_path,
    shift_applied, shift_x, shift_y).
    """
    m = meta.where(F.lower("model_path").contains("1ant")).withColumns(
        {"ex": F.coalesce("shift_x", F.lit(1.0)), "ey": F.coalesce("shift_y", F.lit(1.0))})
    at = close(F.col("x"), F.col("ex")) & close(F.col("y"), F.col("ey"))
    per = probes.join(m.select(*keys, "ex", "ey"), list(keys)).groupBy(*keys).agg(
        F.bool_and(at).alias("placed"), F.bool_and(F.coalesce("in_domain", F.lit(False))).alias("inside"),
        F.bool_and((F.col("n") > 0) & (F.col("n_finite") == F.col("n"))).alias("whole"))
    j = m.join(per, list(keys), "left")
    return j.select(*keys, first_reason(
        (F.col("shift_applied").isNull(), "metadata sin desfase_1antena"), (~F.col("shift_applied"), "desfase_1antena no aplicado"),
        (~F.coalesce("placed", F.lit(True)), "probe_points fuera de la posicion esperada"),
        (~F.coalesce("inside", F.lit(True)), "sonda marcada fuera de dominio"),
        (~F.coalesce("whole", F.lit(True)), "sonda contiene NaN/Inf")).alias("reason"))


def source_reason(stored: DataFrame, current: DataFrame, key: str = "modelo") -> DataFrame:
    """Signature missing, size changed, or modification time off by more than 1e-7 days."""
    j = current.select(key, F.col("bytes").alias("_b"), F.col("mtime_days").alias("_m")).join(stored.select(key, "bytes", "mtime_days"), key, "left")
    changed = (F.col("bytes") != F.col("_b")) | (F.abs(F.col("mtime_days") - F.col("_m")) > 1e-7) | F.col("mtime_days").isNull()
    return j.select(key, first_reason((F.col("bytes").isNull(), "modelo existente sin firma de archivo"), (changed, "archivo cambiado")).alias("reason"))


def reextract(*reasons: Column) -> Column:
    """The first reason along the chain of checks."""
    return F.coalesce(*reasons)


def incompatible_fields(corr: Mapping[str, Column], data: Mapping[str, Column]) -> Column:
    """Identity fields in which a correction and a dataset disagree, joined by commas."""
    out = []
    for name in ("tipo", "antena", "caso", "potencia_w"):
        a, b = corr[name], data[name]
        ok = close(a, b) if name in ("caso", "potencia_w") else F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
        out.append(F.when(~ok, F.lit(name)))
    return F.concat_ws(", ", *out)
