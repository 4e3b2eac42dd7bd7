"""Copies and conflicts of datasets, and the split of an archive by identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..operators import catalog as K

# Provenance columns that do not count as content.
PROVENANCE = ("fecha_extraccion", "fecha_generacion", "ruta_entrada", "archivo_origen", "source_signature",
              "partition_meta", "fuentes_equivalentes", "partition_key")


def content_digest(rows: DataFrame, key: str) -> DataFrame:
    """Order-free digest of the rows of every file: row count and exact sums of two row hashes.

    Combined map-side, so a file of any size costs one partial row per task.
    """
    cols = sorted(c for c in rows.columns if c != key and c not in PROVENANCE)
    body = F.struct(*cols)
    h1, h2 = F.xxhash64(body), F.xxhash64(F.lit(1), body)
    return rows.groupBy(key).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(h1.cast("decimal(20,0)")).cast("string"),
                                             F.sum(h2.cast("decimal(20,0)")).cast("string")).alias("digest"))


def equal_rows(rows: DataFrame, pairs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Exact comparison of copies with their canonical file: (copy, equal); missing values agree.

    ``pairs`` holds (copy, canonical). Rows of both sides are tagged and counted per content, a
    row-level aggregate that never pairs rows with each other.
    """
    a = pairs.join(rows.withColumnRenamed(key, "copy"), "copy").select("copy", *columns, F.lit(1).alias("_w"))
    b = pairs.join(rows.withColumnRenamed(key, "canonical"), "canonical").select("copy", *columns, F.lit(-1).alias("_w"))
    per = a.unionByName(b).groupBy("copy", *columns).agg(F.sum("_w").alias("_w"))
    return per.groupBy("copy").agg((F.max(F.abs("_w")) == 0).alias("equal"))


# Reasons, and the details of a conflict that could not be decided by content.
BEST, EQUAL, CONFLICT = "mejor puntaje", "contenido termico identico", "misma metadata con contenido diferente o no verificable"
NOT_COMPARED, UNREADABLE_BEST, UNREADABLE_COPY = "comparacion deshabilitada", "canonico ilegible: ", "comparacion fallida: "


def organise(entries: DataFrame, content: DataFrame | None = None, columns: Sequence[str] = (), compare: bool = True) -> DataFrame:
    """Category of every copy: ``canonico``, ``equivalente`` or ``conflicto``, with the reason.

    ``entries`` holds ruta, clave_semantica, puntaje, mtime, seq and digest; a file that could not be read has a NULL digest and, if the column
    exists, the cause in ``error``. The canonical copy is one aggregate row per key, so a key shared by very many copies is split
    by the join, not gathered. With ``content`` (ruta and ``columns``), copies whose digests agree are compared exactly as well. An unreadable
    file equals nothing: its conflict says which side could not be read. ``compare=False`` compares no content at all. Nothing is deleted.
    """
    e = entries if "error" in entries.columns else entries.withColumn("error", F.lit(None).cast("string"))
    best = K.canonical_rows(e.select("clave_semantica", "ruta", "puntaje", "mtime", "seq", "digest", "error"), "clave_semantica", "puntaje", "mtime", "seq") \
        .select("clave_semantica", F.col("ruta").alias("canonica"), F.col("digest").alias("_d"), F.col("error").alias("_e"))
    j = e.join(best, "clave_semantica").withColumn("_same", F.lit(compare) & F.coalesce(F.col("digest") == F.col("_d"), F.lit(False)))
    if content is not None:
        pairs = j.where("_same AND ruta != canonica").select(F.col("ruta").alias("copy"), F.col("canonica").alias("canonical"))
        j = j.join(equal_rows(content, pairs, "ruta", columns), F.col("ruta") == F.col("copy"), "left").withColumn("_same", F.col("_same") & F.coalesce("equal", F.lit(False))).drop("copy", "equal")
    category = F.when(F.col("ruta") == F.col("canonica"), "canonico").when(F.col("_same"), "equivalente").otherwise("conflicto")
    cause = lambda head, error: F.concat(F.lit(head), F.coalesce(error, F.lit("sin detalle")))
    detail = F.lit(NOT_COMPARED) if not compare else F.when(F.col("_d").isNull(), cause(UNREADABLE_BEST, F.col("_e"))).when(F.col("digest").isNull(), cause(UNREADABLE_COPY, F.col("error")))
    conflict = F.concat(F.lit(CONFLICT), F.coalesce(F.concat(F.lit(" ("), detail, F.lit(")")), F.lit("")))
    reason = F.when(F.col("category") == "canonico", BEST).when(F.col("category") == "equivalente", EQUAL).otherwise(conflict)
    return j.withColumn("category", category).withColumn("reason", reason).select(*entries.columns, "canonica", "category", "reason")


def split_archive(inventory: DataFrame, index: DataFrame, done: DataFrame, level: str = "full", keep_incomplete: bool = False) -> dict[str, DataFrame]:
    """Routes of an archive: every (model, dataset) to its folder, the merged index and what was left out.

    ``inventory`` holds ruta, modelo, dataset, bytes, seq, the presence flags and optional
    explicit identity columns (caso_meta, potencia_meta). ``done`` lists (key, signature) already
    written; those are skipped.
    """
    case_tag, power_tag = M.tag_identity("dataset")
    count = F.regexp_extract("modelo", r"(\d+)ant", 1).try_cast("double")
    inv = K.without_reserved(inventory, "dataset").withColumns({
        "tipo": M.antenna_type("modelo", ignore_case=False), "num_antenas": count,
        "antena": F.concat(count.cast("int").cast("string"), F.lit("ant")),
        "caso": M.first_known(F.col("caso_meta"), case_tag), "potencia_w": M.first_known(F.col("potencia_meta"), power_tag)})
    usable, reason = M.usability(F.col("tipo"), F.col("num_antenas"), F.col("caso"), F.col("potencia_w"))
    has = F.col("has_snapshots") | F.col("has_full_field") | F.col("has_probes")
    inv = inv.withColumns({"usable": usable, "motivo": F.when(~has, F.lit("sin contenido termico")).otherwise(reason), "valid": has})
    inv = inv.withColumns({
        "partition_key": M.partition_key(F.col("modelo"), F.col("dataset")),
        "carpeta": M.partition_folder(F.col("tipo"), F.col("antena"), F.col("caso"), F.col("potencia_w"), level)})
    take = inv.where(F.col("valid") if keep_incomplete else F.col("valid") & F.col("usable"))
    signed = take.withColumn("key", F.lower("partition_key")).withColumn("signature", F.concat_ws("|", "ruta", F.col("bytes").cast("string")))
    routes = K.not_current(signed, done)
    fresh = routes.select(F.concat_ws("/", "carpeta", F.concat(M.sanitize("partition_key", "partition"), F.lit(".mat"))).alias("ruta"), F.col("ruta").alias("fuente"),
                          "modelo", "dataset", "partition_key", "tipo", "antena", "num_antenas", "caso", "potencia_w", "seq")
    return {"routes": routes, "index": K.upsert_index(index, fresh), "omitted": inv.join(take.select("ruta", "modelo", "dataset"), ["ruta", "modelo", "dataset"], "left_anti")}
