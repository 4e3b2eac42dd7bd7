"""Mesh files to voxel representations, with an outcome for every file (C20)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..operators import mesh as ME
from ..operators import voxel as VX
from ..operators.catalog import passes_optional
from ..session import cut

# Version of the signature, outcomes in the order in which they are decided, clipping distance in voxels.
SIGNATURE = "stl_preprocess_v2"
NO_METADATA, FILTERED, TOO_EARLY, CURRENT, PROCESSED = OUTCOMES = ("omitida_metadata", "omitida_filtro", "descartada_tiempo", "existente", "procesada")
TRUNCATED = 2
KINDS = ("mascara", "sdf", "tsdf")


def states(files: DataFrame, done: DataFrame, resolution: float, kind: str = "sdf", wanted: Mapping[str, object] | None = None) -> DataFrame:
    """The state table: every file outside the quarantine with its identity, ``signature`` and ``outcome``.

    ``files`` holds (mesh_id, ruta, bytes, mtime_days); ``done`` the paths and signatures of earlier runs. A file is left out for an incomplete identity,
    by ``wanted`` values of identity fields, by the early-minute rule, or because its signature is current; the first reason counts.
    """
    f = M.with_identity(files.where(~M.quarantined("ruta")))
    sign = F.concat_ws("|", F.lit(SIGNATURE), M.file_name("ruta"), F.col("bytes").cast("string"), F.format_string("%.6f", F.col("mtime_days")), F.lit(kind), F.format_string("%.6f", F.lit(float(resolution))))
    known = done.select("ruta", "signature").distinct().withColumn("_done", F.lit(True))
    f = f.withColumn("signature", sign).join(known, ["ruta", "signature"], "left")
    usable, reason = M.usability(F.col("tipo"), F.col("num_antenas"), F.col("caso"), F.col("potencia_w"))
    passes = reduce(lambda a, b: a & b, [passes_optional(F.col(c), F.lit(v), numeric=not isinstance(v, str)) for c, v in (wanted or {}).items()], F.lit(True))
    early = F.coalesce(M.early_time("ruta", F.col("tiempo_ejecucion_min")), F.lit(False))
    outcome = F.when(~usable, NO_METADATA).when(~passes, FILTERED).when(early, TOO_EARLY).when(F.col("_done"), CURRENT).otherwise(PROCESSED)
    return f.withColumns({"outcome": outcome, "motivo": F.when(~usable, reason)}).drop("_done")


def counters(state: DataFrame) -> DataFrame:
    """(outcome, n) for every outcome, also those that did not occur."""
    n = state.agg(F.array(*[F.struct(F.lit(o).alias("outcome"), F.count_if(F.col("outcome") == o).alias("n")) for o in OUTCOMES]).alias("rows"))
    return n.select(F.inline("rows"))


def represented(facets: DataFrame, resolution: float, kind: str = "sdf") -> DataFrame:
    """Voxels (mesh_id, ix, iy, iz, occ) of every mesh; ``sdf`` adds the signed distance and its clipped form ``tsdf``, ``tsdf`` only that.

    Clipped distances need the neighbourhood of a voxel only; full ones two passes over the grid's axes. Without any voxel
    inside a mesh, ``sdf`` is NULL and ``tsdf`` the clipping distance.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    v = ME.voxelised(facets, resolution).select(ME.MESH, *VX.VOXEL, "occ")
    if kind == "mascara":
        return v
    if kind == "tsdf":
        return VX.truncated_distance(v, [ME.MESH], resolution, TRUNCATED)
    far = TRUNCATED * resolution
    d = VX.signed_distance(v, [ME.MESH], resolution)  # the grid's rim is empty, so a voxel without a distance is too
    return d.withColumns({"occ": F.coalesce(F.col("sdf") < 0, F.lit(False)), "tsdf": F.greatest(F.lit(-far), F.least(F.lit(far), F.coalesce("sdf", F.lit(far))))})


def voxelise(files: DataFrame, facets: DataFrame, done: DataFrame, resolution: float = 0.5, kind: str = "sdf",
             wanted: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C20: (voxels of the files processed now, state table, rows to add to ``done``). Facets of other files are not read further."""
    state = cut(states(files, done, resolution, kind, wanted))
    todo = state.where(F.col("outcome") == PROCESSED)
    own = facets.join(todo.select(ME.MESH).distinct(), ME.MESH, "left_semi")
    return represented(own, resolution, kind), state, todo.select("ruta", "signature")
