"""The trie of shared conversation prefixes, by Spark SQL's ROLLUP over positional turn columns.

A turn's id is a hash of role and text with the text's length in bytes. Eight (``WIDTH``) consecutive turns of a conversation are one
row with a column for each position; ROLLUP over these columns groups all prefixes at once, and grouping_id tells how
long a group's prefix is. A longer conversation goes on in further rows, keyed by the node where the row before ended. To have
these keys without one round for each block, whole blocks are turns of a shorter conversation: their hashes are rolled up in
the same way, level above level, so that a conversation of n turns needs log n rounds, and no row holds more than eight ids.
The nodes at block ends found above are the keys of the blocks below. A node is named by its smallest member and its depth.

Sums over subtrees take the same way: a second ROLLUP over the *nodes* of a block adds up what lies below each in that block, and
block ends have the sum of all that follows from the level above.

Cases: null role or text is empty; turns are ordered by number (null first), then by id; repeated rows are turns like others; rows
without conversation belong to none and are left out. A conversation with a large share of all turns is ranked in ranges and then
lies in many rows. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.operators.skew import ROWS_PER_RANGE, ranked
from thermal_lake.session import cut

WIDTH = 8
CHUNK = 8192

COLUMNS = [f"c{k}" for k in range(WIDTH)]


def number(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def positions(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``conv``, ``pos`` from 0 and ``id`` (16 bytes of hash, 8 of the text's length) of every turn."""
    said_by, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    turns = df.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                      F.concat(F.unhex(F.md5(F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, said).cast("binary"))), number(F.octet_length(said).cast("long"))).alias("id"))
    return ranked(turns.where(F.col("conv").isNotNull()), ["conv"], "turn", ["id"], "pos", rows).select("conv", (F.col("pos") - 1).alias("pos"), "id")


def whole(turns: DataFrame) -> DataFrame:
    """Positions of conversations as they are, with the length of each: the input of :func:`trie`."""
    return turns.join(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len")), "conv")


def regrafted(turns: DataFrame, source: Column, taken: Column, most: int) -> DataFrame:
    """Every conversation begins with the first ``taken`` (at most ``most``) turns of conversation ``source``, all if it has fewer, and
    goes on with its own turns after its first ``taken``. Both are expressions of ``conv``; one left without turns has one row with null ``id``."""
    size = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    size = cut(size.withColumns({"source": source, "h": taken}))
    given = size.select(F.col("conv").alias("source"), F.col("n").alias("given"))
    convs = size.join(given, "source", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0)))).withColumn(
        "len", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv", "source").join(convs.select("conv", "source", "h", "len"), "source").where(F.col("pos") < F.col("h"))
    own = turns.join(convs.select("conv", "h", "given", "len"), "conv").where(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    none = convs.where(F.col("len") == 0).select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), "len")
    return heads.select("conv", "pos", "id", "len").unionByName(own.select("conv", "pos", "id", "len")).unionByName(none)


def in_blocks(items: DataFrame) -> DataFrame:
    """A row for each conversation and block of ``WIDTH`` positions, with the ids as columns."""
    place = F.pmod("pos", F.lit(WIDTH))
    return items.groupBy("conv", F.floor(F.col("pos") / WIDTH).alias("j")).agg(F.max("len").alias("len"), *[F.max(F.when(place == k, F.col("id"))).alias(c) for k, c in enumerate(COLUMNS)])


def rolled(rows: DataFrame, measures: str) -> DataFrame:
    """Measures of every prefix of the blocks; ``i`` is the prefix's length, 0 for the block as a whole. Groups past a row's end are left out."""
    cols = ", ".join(COLUMNS)
    grouped = rows.sparkSession.sql(f"SELECT key, j, {cols}, {WIDTH} - bit_count(grouping_id()) AS i, {measures} FROM {{rows}} GROUP BY key, j, ROLLUP ({cols})", rows=rows)
    return grouped.where((F.col("i") == 0) | F.coalesce(*[F.when(F.col("i") == k + 1, F.col(c).isNotNull()) for k, c in enumerate(COLUMNS)]))


def node(length: Column) -> Column:
    """Name of the node that ``length`` columns of a row lead to from its key."""
    none = F.lit(b"")
    path = [F.when(length > k, F.coalesce(F.col(c), none)).otherwise(none) for k, c in enumerate(COLUMNS)]
    return F.unhex(F.md5(F.concat(number(F.col("key")), number(F.col("j")), number(length.cast("long")), *path)))


def trie(items: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``items`` has ``conv``, ``pos``, ``id`` and ``len``, as :func:`whole` and :func:`regrafted` give them.
    """
    items = cut(items)
    bounds = items.agg(F.max("len").alias("len"), F.min("conv").alias("root")).first()
    if bounds["len"] is None:
        return items.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    levels = [cut(in_blocks(items))]
    left = bounds["len"]
    while left > WIDTH:
        left //= WIDTH
        full = levels[-1].where(F.col(COLUMNS[-1]).isNotNull()).select("conv", F.col("j").alias("pos"), F.unhex(F.md5(F.concat(*COLUMNS))).alias("id"), "len")
        levels.append(cut(in_blocks(full)))

    # downwards: the key of each block is the node where the block before it ended
    nodes, keyed = [], levels[-1].withColumn("key", F.lit(0).cast("long"))
    for level in range(len(levels) - 1, -1, -1):
        found = rolled(keyed, "min(conv) AS rep, count(1) AS n").where((F.col("i") > 0) | ((F.col("j") == 0) & F.lit(level == 0)))
        found = cut(found.withColumn("node", node(F.col("i"))))
        nodes.append(found)
        if level:
            steps = F.explode(F.filter(F.array(*[F.struct(F.lit(k + 1).alias("i"), node(F.lit(k + 1)).alias("node"), F.col(c).isNotNull().alias("here")) for k, c in enumerate(COLUMNS)]), lambda s: s["here"]))
            ends = keyed.select("conv", "j", steps.alias("s")).select("conv", (F.col("j") * WIDTH + F.col("s.i")).alias("j"), F.col("s.node").alias("node"))
            keys = ends.join(found.select("node", F.col("rep").alias("key")), "node").select("conv", "j", "key")
            below = levels[level - 1]
            keyed = below.where("j = 0").withColumn("key", F.lit(0).cast("long")).unionByName(below.where("j > 0").join(keys, ["conv", "j"]))
            keyed = cut(keyed) if level == 1 else keyed
    nodes.reverse()

    # what a node is by itself
    i, j = F.col("i"), F.col("j")
    up = nodes[0].select(F.col("node").alias("above"), F.col("rep").alias("over"))
    base = nodes[0].withColumns({"depth": j * WIDTH + i, "above": F.when(i > 1, node(i - 1))}).join(up, "above", "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("over", F.when(j > 0, F.col("key")), F.lit(bounds["root"])))
    last = F.coalesce(*[F.when(i == k + 1, F.col(c)) for k, c in enumerate(COLUMNS)])
    size = F.coalesce(F.conv(F.hex(F.substring(last, 17, 8)), 16, 10).cast("long"), F.lit(0))
    base = cut(base.select("key", "j", "i", *COLUMNS, "node", "rep", "n", "depth", parent.alias("parent"), ((F.col("n") - 1) * size).alias("saved")))
    children = base.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    base = base.join(children, ["rep", "depth"], "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    base = cut(base.withColumn("leaves", (F.col("children") == 0).cast("long")))

    # upwards: what lies in each block; then downwards: with that, what lies below each block end
    weighted = [base.select("key", "j", "i", *COLUMNS, "rep", "leaves", "saved")]
    for level in range(1, len(levels)):
        inside = weighted[-1].where("j > 0").groupBy(F.col("key").alias("rep"), F.col("j").alias("at")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        ends = nodes[level].select("key", "j", "i", *COLUMNS, "rep", (j * WIDTH + i).alias("at"))
        weighted.append(cut(ends.join(inside, ["rep", "at"], "left").fillna(0, ["leaves", "saved"]).drop("at")))
    measures = "min(rep) AS rep, sum(leaves) AS leaves, sum(saved) AS saved"
    sums = None
    for level in range(len(levels) - 1, -1, -1):
        rows = weighted[level]
        if sums is not None:
            after = sums.select("rep", (j * WIDTH + i - 1).alias("j"), F.lit(WIDTH).alias("i"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
            rows = rows.join(after, ["rep", "j", "i"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))}).drop("_l", "_s")
        sums = rolled(rows, measures).where((i > 0) | (j == 0) & F.lit(level == 0))
    total = sums.select("rep", (j * WIDTH + i).alias("depth"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))

    out = base.select("rep", "depth", "node", "parent", "n", "children").join(total, ["rep", "depth"]).join(ending(keyed), "node", "left")
    return out.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def ending(keyed: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of every node where conversations end.

    Ids are joined per node and range of ``CHUNK`` ids, which holds that many at most; the hash then takes range after range
    as a stream, so that a node where a third of all conversations end needs no more memory than others.
    """
    last = keyed.where(F.col("j") == F.greatest(F.floor((F.col("len") - 1) / WIDTH), F.lit(0)))
    length = F.col("len") - F.col("j") * WIDTH
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    texts = last.select(node(length).alias("node"), "conv").groupBy("node", F.floor(F.col("conv") / CHUNK).alias("range")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            names, sums = [], []
            for name, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != at:
                    if at is not None:
                        names.append(at)
                        sums.append(sha.hexdigest())
                    at, sha = name, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.string())], ["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    return texts.repartition("node").sortWithinPartitions("node", "range").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


#: The trie for DuckDB, of conversations that begin with the first h turns of conversation c - c % 5; h is the checksum of the
#: decimal id modulo 9. That engine has no crc32, so it is reduced bit by bit.
SQL = """
WITH turns AS (
  SELECT conv_id AS c, list(md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || ':' || strlen(coalesce(text, ''))
         ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (
  SELECT c, s, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda r, b:
         list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384::UBIGINT * (v & 1)), xor(r, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 9 AS h FROM turns),
rebuilt AS (
  SELECT a.c, list_concat(list_slice(coalesce(p.s, []), 1, a.h::BIGINT), list_slice(a.s, a.h::BIGINT + 1, len(a.s))) AS s
  FROM headed a LEFT JOIN turns p ON p.c = a.c - a.c % 5),
members AS (SELECT c, d, array_to_string(list_slice(s, 1, d), '/') AS k, len(s) AS n, s[d] AS last, CASE WHEN d > 0 THEN array_to_string(list_slice(s, 1, d - 1), '/') END AS up
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(any_value(string_split(last, ':')[2])::BIGINT, 0) AS saved
  FROM members GROUP BY d, k),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(x.n_children, 0) AS n_children FROM nodes n
  LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.up
  LEFT JOIN (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, up) x ON x.d = n.d AND x.k = n.k),
below AS (
  SELECT m.d, m.k, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM linked u JOIN members m ON m.c = u.conv_id AND m.d <= u.d GROUP BY m.d, m.k)
SELECT l.conv_id, l.d::BIGINT AS depth, l.parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON b.d = l.d AND b.k = l.k
"""
