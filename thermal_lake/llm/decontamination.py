"""Benchmark passages in documents, up to a share of edits.

Texts are compared by code points after A-Z become lower case and runs of white space one space. An item of n code points may
differ from a passage by ``e = floor(rate * n)`` insertions, deletions or replacements. Cut into e + 1 pieces, one piece at
least must stand in the passage unchanged. All places of a document are hashed by one running sum; places whose hash is
that of some piece's first bytes are compared with the whole piece, and the passage around a true hit is measured with Myers'
bit-parallel distance, whatever its length.

The items are a query set: they are taken in blocks of about ``block`` bytes, and every block goes over all documents. So what a
task holds does not grow with the benchmark.

Cases: null or empty texts and items match nothing. Items under ``shortest`` code points are too common to tell anything and are left
out. An item given twice counts once for each document, with its smallest distance; so does a passage found twice. Repeated
rows of documents give one row for each key. Long texts are searched whole. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, byte_values, powers, slices, text_bytes, tidy

RATE = 0.05
SHORTEST = 20
BLOCK = 16 << 20
_PLAIN = LOWER.copy()
_PLAIN[0x09:0x0E] = 0x20


def plain(text: str) -> str:
    """A text as it is compared; the plain form of :func:`plain_bytes`."""
    return BLANK.sub(" ", text).translate({c: c + 32 for c in range(65, 91)})


def plain_bytes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case and single spaces in all texts; white space of two texts stays apart."""
    out = _PLAIN[data]
    gap = out == 0x20
    drop = np.concatenate(([False], gap[1:] & gap[:-1])) if len(gap) else gap
    starts = offs[:-1][offs[:-1] < len(data)]
    drop[starts] = False
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~drop, out=at[1:])
    return out[~drop], at[offs]


def distance(item: str, text: str) -> int:
    """Smallest edit distance between ``item`` and a part of ``text`` (Myers 1999); one machine step for each code point."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, m
    for c in text:
        eq = at.get(c, 0)
        vertical = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(flat | up), up & flat
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
            if score < best:
                best = score
        rise, fall = rise << 1, fall << 1
        up, down = (fall | ~(vertical | rise)) & mask, rise & vertical & mask
    return best


class Items:
    """One block of items, cut into pieces that are found by the hash of their first ``width`` bytes."""

    def __init__(self, items: list[tuple[int, str]], rate: float, shortest: int):
        self.items = [(i, p, int(rate * len(p))) for i, t in items if len(p := plain(t or "").strip(" ")) >= shortest]
        found = []
        for k, (_, text, e) in enumerate(self.items):
            edges = [len(text) * j // (e + 1) for j in range(e + 2)]
            at = 0
            for a, b in zip(edges, edges[1:]):
                piece = text[a:b].encode()
                found.append((k, at, piece))
                at += len(piece)
        self.width = min((len(p) for _, _, p in found), default=1)
        self.pieces: dict[int, list[tuple[int, int, bytes]]] = {}
        for k, at, piece in found:
            h = int(_running(np.frombuffer(piece[: self.width], np.uint8), self.width)[0])
            self.pieces.setdefault(h, []).append((k, at, piece))
        self.known = np.array(sorted(self.pieces), np.uint64)
        bits = max(12, (32 * len(self.known)).bit_length())  # a table small enough to stay in cache lets few other places through
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.known >> self.shift] = True

    def search(self, col: pa.Array) -> list[dict[int, int]]:
        """For each text: the items found and their distances."""
        data, offs = plain_bytes(*text_bytes(col))
        out: list[dict[int, int]] = [{} for _ in range(len(col))]
        if not self.items or len(data) < self.width:
            return out
        h = _running(data, self.width)
        places = np.flatnonzero(self.filter[h >> self.shift])
        places = places[np.isin(h[places], self.known)]
        docs = np.searchsorted(offs, places, "right") - 1
        passages: dict[tuple[int, int], list[tuple[int, int]]] = {}
        raw = data.tobytes()
        for place, doc in zip(places.tolist(), docs.tolist()):
            for k, at, piece in self.pieces[int(h[place])]:
                if place + len(piece) <= offs[doc + 1] and raw.startswith(piece, place):
                    text, e = self.items[k][1:]
                    size = len(text.encode())
                    start = place - at
                    if start >= offs[doc] and raw.startswith(text.encode(), start) and start + size <= offs[doc + 1]:
                        out[doc][self.items[k][0]] = 0
                    else:
                        # e insertions or deletions move a border by four bytes each at most
                        passages.setdefault((doc, k), []).append((max(int(offs[doc]), start - 4 * e), min(int(offs[doc + 1]), start + size + 8 * e)))
        for (doc, k), spans in passages.items():
            item, text, e = self.items[k]
            if out[doc].get(item, e + 1) == 0:
                continue
            for a, b in _joined(spans):
                near = distance(text, raw[a:b].decode("utf8", "ignore"))
                if near <= e:
                    out[doc][item] = min(near, out[doc].get(item, near))
        return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _running(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every place on."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(data) * up[: len(data)], out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: len(data) - width + 1] * np.uint64(0xD6E8FEB86659FD93)


def item_blocks(benchmark: DataFrame, item: str, text: str, rate: float, shortest: int, block: int) -> Iterator[Items]:
    """Blocks of items, dealt by hash; the size of the whole benchmark is counted first."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-total // block) or 1
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == b).select(item, text).distinct().collect()
        yield Items([(r[0], r[1]) for r in rows], rate, shortest)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", rate: float = RATE, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """(key, item, edits): one row for each item that a document holds, with its smallest distance."""
    parts = []
    kinds = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    kind = pa.int64() if kinds[1] == "bigint" else None
    for items in item_blocks(benchmark, item, text, rate, shortest, block):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tidy()
            for batch in batches:
                for part in slices(batch, "t"):
                    hits = [(i, k, e) for i, found in enumerate(held.value.search(part.column(1))) for k, e in found.items()]
                    if hits:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([h[0] for h in hits])), pa.array([h[1] for h in hits], kind), pa.array([h[2] for h in hits], pa.int32())], names=["k", "i", "edits"])

        parts.append(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kinds[0]}, i {kinds[1]}, edits int"))
    out = reduce(DataFrame.unionByName, parts)
    return out.groupBy(F.col("k").alias(key), F.col("i").alias(item)).agg(F.min("edits").alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", rate: float = RATE, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold an item; their texts are not shuffled."""
    for items in item_blocks(benchmark, item, text, rate, shortest, block):
        held = docs.sparkSession.sparkContext.broadcast(items)
        place = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], held=held, place=place) -> Iterator[pa.RecordBatch]:
            tidy()
            for batch in batches:
                for part in slices(batch, batch.schema.names[place]):
                    keep = [not found for found in held.value.search(part.column(place))]
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
