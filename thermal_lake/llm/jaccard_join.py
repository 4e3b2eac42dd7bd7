"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Two documents link when 100 * |A and B| >= threshold * |A or B|,
that is, when |A xor B| <= (100 - threshold) / (100 + threshold) * (|A| + |B|).

1. ``describe`` hashes every text: set size, a fingerprint of the set, and a parity sketch, in which every shingle flips
   one bit. The Hamming distance of two sketches never exceeds |A xor B|. Equal sets become one class, once and for all.
2. ``pieces`` deals the shingles of a document into p hash classes and XORs the hashes in each: slices of one very long
   parity sketch. Sizes are banded, so that p can follow size. A document is indexed in its own band and in every higher one
   where something larger by the threshold could lie. At most d shingles differ between linked documents of a band, so
   of p = d + 1 + 2s slices at least 2s + 1 agree; each document leaves out its s lightest slices (empty ones, or of one common
   shingle), and one agreeing slice is still indexed on both sides.
3. ``groups`` sorts equal slices together and ties all their documents to the smallest: a row for each document,
   not for each pair. Documents tied to one leader are a candidate group; linked documents always share one.
4. ``sketched`` walks each group from document to document: only those not reached yet are compared, by sketches, so a
   group of near copies costs about its size. Groups above ``block`` documents are compared by pairs of blocks in tasks of their own.
5. ``linked`` repeats the walk within what was reached, with exact shingle sets, and emits true links only: at most one less
   than there are documents. Components of these links are the components of all links.

Shingles and sets are compared by 64-bit and 128-bit hashes of their characters.

Cases: a null or empty text has no shingles and links with nothing. A text with fewer words than a shingle has the whole
sequence as its one shingle. Rows without a key get their counts and no component. Repeated keys are one document for
each text and share a component. Very long texts are hashed whole. Empty tables give empty results. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermal_lake.session import cut, scratch_path

from .common import mix, slices, small, span_hash, text_bytes, tidy, windows, words_of

RATIO = 1.5  # of the bands of set sizes
BLOCK = 8192  # documents of a group that one task compares
SPREAD = 0.1  # share of slices that a document leaves out


def shingles(col: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offs = text_bytes(col)
    w = words_of(data, offs)
    h = w.hashes(lower=True)
    first, _ = windows(w.at, k)
    full = span_hash(h, first, first + k)
    count = np.diff(w.at)
    ends = np.cumsum(np.maximum(count - k + 1, 0))
    short = (count > 0) & (count < k)
    whole = span_hash(h, w.at[:-1][short], w.at[1:][short])
    few = dict(zip(np.flatnonzero(short).tolist(), whole))
    out, at = [], 0
    for i, e in enumerate(ends.tolist()):
        out.append(np.array([few[i]], np.uint64) if i in few else np.unique(full[at:e]))
        at = e
    return out


def smallest(threshold: int) -> int:
    """The smallest n for which sets of n and n + 1 can link; smaller sets link with equal ones only."""
    return -(-threshold // (100 - threshold)) if threshold < 100 else 1 << 40


def bands(threshold: int) -> np.ndarray:
    """Smallest sizes of the bands; sizes under the first cannot link with a different set."""
    out = [smallest(threshold)]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * RATIO) + 1)
    return np.array(out, np.int64)


def differing(total: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """Most shingles that may differ between linked sets whose sizes sum to ``total``."""
    return (100 - threshold) * total // (100 + threshold)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch with two to four bits a shingle, a power of two of 64-bit words."""
    words = 1 << max(0, (2 * len(s) - 1) // 64).bit_length()
    bit = s & np.uint64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def fold(s: np.ndarray, words: int) -> np.ndarray:
    """The sketch of fewer words; distances only fall."""
    while len(s) > words:
        half = len(s) // 2
        s = s[:half] ^ s[half:]
    return s


def _hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    a, b = mix(s ^ np.uint64(0x51ED270B)), mix(s + np.uint64(0x2545F4914F6CDD1D))
    return tuple(int((x.sum(dtype=np.uint64) ^ np.uint64(len(s))).astype(np.int64)) for x in (a, b))


def describe(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, c, c2, sketch) of every row: set size, fingerprints and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for part in slices(batch, "t"):
                sets = shingles(part.column(1), k)
                prints = [_hashes(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["id", "n", "c", "c2", "sketch"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, n long, c long, c2 long, sketch binary")


def slice_keys(sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexed slices of several sets: the number of the set and the key of the slice."""
    starts, sizes = bands(threshold), np.array([len(s) for s in sets])
    all_docs, all_keys = [], []
    for up in range(len(starts)):
        band = np.searchsorted(starts, sizes, "right") - 1 + up
        use = sizes >= starts[0]
        if up:
            use &= sizes * 100 >= starts[np.minimum(band, len(starts) - 1)] * threshold  # something linked may be as large as that band's first
        if not use.any():
            break
        docs = np.flatnonzero(use)
        n, band = sizes[docs], band[docs]
        most = starts[band + 1] - 1
        d = differing(2 * most, threshold)
        spare = np.maximum(1, (SPREAD * (d + 1) / (1 - 2 * SPREAD)).astype(np.int64))
        p = d + 1 + 2 * spare
        base = np.cumsum(p) - p
        h = mix(np.concatenate([sets[i] for i in docs]) + np.repeat(band, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.repeat(base, n) + ((h >> np.uint64(32)) * np.repeat(p, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(p.sum())
        value, count = np.zeros(total, np.uint64), np.bincount(at, minlength=total)
        np.bitwise_xor.at(value, at, mix(h))
        of = np.repeat(np.arange(len(docs)), p)
        index = np.arange(total) - base[of]
        lightest = np.argsort(of * (int(count.max()) + 1) + count, kind="stable")
        kept = lightest[np.arange(total) - base[of] >= spare[of]]
        where = band[of[kept]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + index[kept].astype(np.uint64)
        all_keys.append(mix(value[kept] ^ mix(where)).astype(np.int64))
        all_docs.append(docs[of[kept]])
    return (np.concatenate(all_docs), np.concatenate(all_keys)) if all_docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pieces(docs: DataFrame, text: str, k: int, threshold: int) -> DataFrame:
    """(key, c): a row for each indexed slice of each set; a slice of the input names equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        seen: set[int] = set()
        least = smallest(threshold)
        for batch in batches:
            for part in slices(batch, "t"):
                new, ids = [], []
                for s in shingles(part.column(0), k):
                    c = _hashes(s)[0]
                    if len(s) >= least and c not in seen:
                        seen.add(c)
                        new.append(s)
                        ids.append(c)
                if len(seen) > 1 << 16:
                    seen.clear()
                if new:
                    of, keys = slice_keys(new, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(ids, np.int64)[of])], names=["key", "c"])

    return docs.select(F.col(text).alias("t")).where("t is not null").mapInArrow(run, "key long, c long")


def groups(keyed: DataFrame) -> DataFrame:
    """(leader, c), distinct: every document of a slice that several share, and the smallest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        at = lead = None  # the run that the last batch ended in
        for batch in batches:
            key, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.concatenate(([at is None or key[0] != at], key[1:] != key[:-1]))
            heads = c[np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))]
            if not new[0]:
                heads[: new.argmax() if new.any() else len(c)] = lead
            at, lead = key[-1], heads[-1]
            hit = heads != c
            if hit.any():
                pair = np.unique(np.stack([heads[hit], c[hit]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["leader", "c"])

    ties = cut(keyed.repartition("key").sortWithinPartitions("key", "c").mapInArrow(run, "leader long, c long").distinct())
    return ties.unionByName(ties.select("leader", F.col("leader").alias("c")).distinct())


def dealt(members: DataFrame, key: list[str], block: int) -> DataFrame:
    """``members`` with a column ``pair``: the pairs of blocks of its group that a row takes part in.

    A group of up to ``block`` rows is one pair; a larger one has so many blocks that every two meet in one task.
    """
    size = members.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > block).withColumn("_b", F.ceil(F.col("_n") / F.lit(block // 2)).cast("int"))
    joined = members.join(size, key, "left").withColumn("_own", F.pmod(F.xxhash64("id"), F.coalesce("_b", F.lit(1))).cast("int"))
    pairs = F.expr("if(_b is null, array(0L), transform(filter(sequence(0, _b - 1), i -> i != _own), i -> least(i, _own) * 4294967296L + greatest(i, _own)))")
    return joined.withColumn("pair", F.explode(pairs)).drop("_n", "_b", "_own")


def walk(n: np.ndarray, sketches: list[np.ndarray], threshold: int, same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that reach every row from the first of its component; ``same`` decides what the sketches leave open."""
    words = min(map(len, sketches))
    table = np.stack([fold(s, words) for s in sketches])
    rest, out = np.arange(len(n)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            q = front.pop()
            near = np.bitwise_count(table[rest] ^ table[q]).sum(1, dtype=np.int64) <= differing(n[rest] + n[q], threshold)
            if not near.any():
                continue
            if same is not None:
                near[near] = [same(q, r) for r in rest[near].tolist()]
            reached = rest[near]
            out.extend((q, int(r)) for r in reached)
            front.extend(reached.tolist())
            rest = rest[~near]
    return out


def by_group(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that agree in the first ``width`` (long) columns, from batches in that order."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(width)], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        if held and (keys[0] != last).any():
            yield joined()
            held = []
        for a, b in zip(edges, edges[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield joined()
                held = []
        last = keys[-1]
    if held:
        yield joined()


def sketched(members: DataFrame, threshold: int, block: int) -> DataFrame:
    """(leader, pair, part, id, c): parts of a group whose sketches are near enough to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        cols: list[list[int]] = [[] for _ in names]
        for g in by_group(batches, 2):
            if g.num_rows < 2:
                continue
            n, ids, prints = (g.column(i).to_numpy() for i in (4, 2, 3))
            links = walk(n, [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column(5)], threshold)
            head: dict[int, int] = {}
            for q, r in links:
                head[r] = head.setdefault(q, q)
            for i, h in head.items():
                for c, v in zip(cols, (g.column(0)[0].as_py(), g.column(1)[0].as_py(), prints[h], ids[i], prints[i])):
                    c.append(v)
            if len(cols[0]) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
                cols = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    names = ["leader", "pair", "part", "id", "c"]
    rows = dealt(members, ["leader"], block).select("leader", "pair", "id", "c", "n", "sketch")
    return rows.repartition("leader", "pair").sortWithinPartitions("leader", "pair", "id", "c").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def linked(parts: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): true links that join the rows of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for g in by_group(batches, 3):
            if g.num_rows < 2:
                continue
            ids, own = g.column(3).to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column(4)]

            def same(q: int, r: int) -> bool:
                both = len(own[q]) + len(own[r]) - len(np.union1d(own[q], own[r]))
                return 100 * both >= threshold * (len(own[q]) + len(own[r]) - both)

            links = walk(np.array([len(s) for s in own]), [sketch(s) for s in own], threshold, same)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(ids[[q for q, _ in links]]), pa.array(ids[[r for _, r in links]])], names=["a", "b"])

    rows = parts.join(sets, ["id", "c"]).select("leader", "pair", "part", "id", "shingles")
    return rows.repartition("leader", "pair", "part").sortWithinPartitions("leader", "pair", "part", "id").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each end of a link reaches.

    Every round, each node's neighbours are tied to its smallest neighbour, first the larger ones and then the smaller
    (large-star, small-star); the number of rounds grows with the logarithm of the number of nodes.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("u < v").distinct()
        new = cut(small)
        after = state(new)
        if after == before:
            return new.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root")).unionByName(new.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        edges, before = new, after


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, c, shingles) of the wanted (id, c, c2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for part in slices(batch, "t"):
                sets = shingles(part.column(3), k)
                use = [i for i, (s, a, b) in enumerate(zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist())) if _hashes(s) == (a, b)]
                pick = pa.array(use, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array([sets[i].tobytes() for i in use], pa.binary())], names=["id", "c", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(small(wanted), "id").select("id", "c", "c2", "t")
    return rows.mapInArrow(run, "id long, c long, shingles binary").groupBy("id", "c").agg(F.first("shingles").alias("shingles"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, threshold: int = 85, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, class_id (smallest key with an equal set) and component_id of every row."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "sets")
    describe(docs, key, text, k).write.parquet(path)
    rows = spark.read.parquet(path)
    named = rows.where("id is not null and n > 0")
    classes = cut(named.groupBy("c", "c2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    tied = groups(pieces(docs, text, k, threshold))
    members = tied.join(classes, "c").select("leader", "id", "c", "n", "sketch")
    parts = cut(sketched(members, threshold, block))
    wanted = cut(parts.select("id", "c").distinct().join(classes.select("id", "c", "c2"), ["id", "c"]))
    links = linked(parts, shingle_sets(docs, wanted, key, text, k), threshold)
    root = components(links).select(F.col("id").alias("own"), "root")
    out = rows.select("id", "n", "c", "c2").join(classes.select("c", "c2", F.col("id").alias("own")), ["c", "c2"], "left").join(root, "own", "left")
    has = F.col("id").isNotNull() & (F.col("n") > 0)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(has, F.col("own")).otherwise(F.col("id")).alias("class_id"), F.when(has, F.coalesce("root", "own")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: its smallest key, and of equal keys the smallest row. Rows without a key stay."""
    found = join(docs, key, text, k, threshold, block)
    gone = cut(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct())
    left = docs.join(small(gone), docs[key].eqNullSafe(F.col("_gone")), "left_anti")
    many = cut(found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_many")).agg(F.count("*").alias("n")).where("n > 1").select("_many"))
    if many.isEmpty():
        return left
    same = left.join(small(many), left[key] == F.col("_many"), "left_semi")
    first = same.groupBy(key).agg(F.min(F.struct(*(c for c in docs.columns if c != key))).alias("_row")).select(key, "_row.*").select(*docs.columns)
    return left.join(small(many), left[key].eqNullSafe(F.col("_many")), "left_anti").unionByName(first)
