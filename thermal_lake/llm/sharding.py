"""Shards by extendible hashing.

A row's bucket is a prefix of the bits of its key's hash. A directory holds, for every prefix, the bucket it leads
to: the shortest prefix whose rows fit the byte limit. So only oversized buckets are split on another bit. Sizes are
summed per cell (a prefix of a few more bits) before anything is decided; a round refines only the cells that are
still too large, so there are never more than ``2^step`` cells for each oversized one.

Cases: a null key is the empty key; a null or empty text has no bytes. A row above the limit gets a shard of its
own (``oversized``). Rows of one key have equal hashes: if together they pass the limit, they are split on the bits
of a hash of their row number. Which of several equal rows goes where may differ between runs. An empty table
gives an empty result. ``assign`` reads only the key and the text; ``write`` numbers the rows once and writes each to the
shard of its number, so that the rows of one key (or of none) go where the split put them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.session import cut

BITS = 60
LIMIT = 1 << 20


def key_bits(key: Column) -> Column:
    """The first 60 bits of the md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _round(rows: DataFrame, low: int, top: int, limit: int) -> DataFrame:
    """For every cell of ``top`` bits: the depth of its bucket and the bucket's size; null where it must be split further."""
    cells = rows.groupBy("g", F.shiftright("h", BITS - top).alias("cell")).agg(F.sum("b").alias("b"), F.count("*").alias("n"))
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(top)))).withColumn("pre", F.expr(f"shiftright(cell, {top} - d)"))
    sums = levels.groupBy("g", "d", "pre").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).where((F.col("b") <= limit) | (F.col("n") == 1))
    found = levels.select("g", "d", "pre", "cell").join(sums, ["g", "d", "pre"]).groupBy("g", "cell").agg(F.min(F.struct("d", "pre", "b", "n")).alias("leaf"))
    return cells.select("g", "cell").join(found, ["g", "cell"], "left")


def _split(rows: DataFrame, limit: int, first: int, step: int) -> tuple[DataFrame, bool]:
    """``rows`` with their ``leaf``, and whether some have none because their hashes agree in all bits."""
    done, low, top, waiting = [], 0, first, rows
    while True:
        cells = cut(_round(waiting, low, top, limit))
        named = cells.select(F.col("g").alias("_g"), F.col("cell").alias("_cell"), "leaf")
        found = waiting.join(named, (F.col("g") == F.col("_g")) & (F.shiftright("h", BITS - top) == F.col("_cell"))).drop("_g", "_cell")
        done.append(found.where(F.col("leaf").isNotNull()))
        left = found.where(F.col("leaf").isNull())
        if cells.where(F.col("leaf").isNull()).isEmpty():
            return reduce(DataFrame.unionByName, done), False
        if top == BITS:
            return reduce(DataFrame.unionByName, [*done, left]), True
        waiting = left.drop("leaf")
        low, top = top + 1, min(BITS, top + step)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, first: int = 12, step: int = 8, row: str | None = None) -> DataFrame:
    """key, shard (its bits), depth, shard_rows, shard_bytes, oversized, and the slots of the directory that lead to it; and ``row``, a column of stable row numbers of ``docs``, if named."""
    b = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    r = F.col(row) if row else F.monotonically_increasing_id()
    rows = cut(docs.select(F.col(key).alias("k"), key_bits(F.col(key)).alias("h"), b.alias("b"), r.alias("r"))).withColumn("g", F.lit(0).cast("long"))
    found, equal = _split(rows, limit, first, step)
    bits = F.expr("if(leaf.d = 0, '', lpad(conv(cast(leaf.pre as string), 10, 2), leaf.d, '0'))")
    named = ["k", "r"] if row else ["k"]
    out = found.where(F.col("leaf").isNotNull()).select(*named, bits.alias("shard"), F.col("leaf.*"))
    if equal:
        again = found.where(F.col("leaf").isNull()).select("k", F.col("h").alias("g"), F.expr(f"shiftrightunsigned(xxhash64(h, r), {64 - BITS})").alias("h"), "b", "r")
        more, _ = _split(again, limit, first, step)
        whole = F.concat(F.lpad(F.conv(F.col("g").cast("string"), 10, 2), BITS, "0"), bits)
        out = out.unionByName(more.select(*named, whole.alias("shard"), F.col("leaf.*")).withColumn("d", F.col("d") + BITS))
    depth = out.agg(F.max("d").alias("top"))
    span = F.expr("if(top > 60, null, shiftleft(1L, top - d))")
    return out.crossJoin(F.broadcast(depth)).select(
        F.col("k").alias(key), *([F.col("r").alias(row)] if row else []), "shard", F.col("d").alias("depth"), F.col("n").alias("shard_rows"), F.col("b").alias("shard_bytes"), (F.col("b") > limit).alias("oversized"),
        (F.col("pre") * span).alias("first_slot"), span.alias("slots"))


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, first: int = 12, step: int = 8) -> None:
    """One folder for each shard below ``path``; a shard is one task's work, as its bytes are limited."""
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))  # written once, so that a row keeps its number
    shards = assign(rows, key, text, limit, first, step, "_row").select("_row", "shard")
    rows.join(shards, "_row").drop("_row").repartition("shard").write.partitionBy("shard").parquet(path)


SQL = f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS b, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint AS h FROM documents),
     p AS (SELECT d, h >> (60 - d) AS pre, sum(b)::bigint AS b, count(*) AS n FROM r, (SELECT unnest(range(0, 25)) AS d) GROUP BY ALL),
     leaf AS (SELECT r.doc_id, min(struct_pack(d := p.d, pre := p.pre, b := p.b, n := p.n)) AS leaf FROM r JOIN p ON p.pre = r.h >> (60 - p.d) WHERE p.b <= {LIMIT} OR p.n = 1 GROUP BY r.doc_id),
     t AS (SELECT max(leaf.d) AS top FROM leaf)
SELECT doc_id, CASE WHEN leaf.d = 0 THEN '' ELSE lpad(bin(leaf.pre), leaf.d::int, '0') END AS shard, leaf.d::int AS depth, leaf.n::bigint AS shard_rows, leaf.b::bigint AS shard_bytes,
       leaf.b > {LIMIT} AS oversized, (leaf.pre * (1::bigint << (top - leaf.d)))::bigint AS first_slot, (1::bigint << (top - leaf.d))::bigint AS slots
FROM leaf, t
"""
