"""Token ids in binary files.

Ids are ranked by frequency over the corpus, so common ids are small numbers. Ranks are stored byte-aligned: a rank takes
one to four bytes, and its length less one stands in two bits of a separate control byte, four ranks to a byte. Decoding
looks lengths up in a table by control byte and gathers the bytes with numpy, without a loop over ids.

A folder holds ``ranks.u32`` (the id of every rank, little-endian) and ``part-00000.ids`` and so on, in ascending order of the key.
A part is a sequence of blocks: the header of HEAD, then for each text its key (null as the smallest long) and number of ids,
then control bytes, then data bytes. A part is written under a temporary name and renamed when it is whole, and its rows and
name depend on the input alone, so a task that runs twice or dies does no harm. Paths may be of any store pyarrow knows.

Texts are encoded with the tokenizers library. Each word is given to it once and remembered, as most words of a text have
been seen before.

Cases: a null or empty text has the end id only. Null keys come first; rows of one key are ordered by their ids. Long texts
are never cut: a block has one text at least. An empty table gives an empty folder and result. Only key and text are read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermal_lake.session import scratch_path

from .bpe import Memo, byte_letters
from .common import MEMORIES, slices

HEAD = "<8sIIQ"  # magic, texts, ids, data bytes
MAGIC = b"tlids\x00\x01\n"
NULL = -(1 << 63)
BLOCK = 1 << 18  # ids of a block, if no text has more
PART = 1 << 24  # ids of a part

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = size - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\x00\x00\x00", np.uint8).astype(np.uint32)
    return (raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16 | raw[at + 3] << 24) & _KEEP[size] if n else np.zeros(0, np.uint32)


class TextEncoder:
    """The tokenizers library with a memory of words; gives ids as little-endian bytes, two each where the vocabulary allows.

    The library's chain for WORDS needs no state across words. In Latin-1 texts without special tokens, they are cut here,
    and each new word is given to the library's BPE model. All other texts go through the whole chain, piece by piece.
    """

    #: The word pattern of the tokenizer, for lower-case Latin-1.
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa00-9²³¹¼½¾a-zªµºß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        self.model = self.all.model
        self.kind = "<u2" if self.all.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.special = [t.content for t in self.all.get_added_tokens_decoder().values()]
        self.words = Memo(self._word, 500_000)
        self.pieces = Memo(self._piece)

    def _word(self, word: str) -> bytes:
        own = word if word.isalpha() and word.isascii() else word.encode().decode("latin1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(own)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array(self.code, self.all.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _latin(text) and not any(t in text for t in self.special):
            return b"".join(map(self.words.__getitem__, self.WORDS.findall(text.lower())))
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


def _latin(text: str) -> bool:
    try:
        text.encode("latin1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


MEMORIES.append(encoder.cache_clear)


def encode(docs: DataFrame, path: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, n, ids): the ids of every text with ``end_id`` behind them, as 16-bit numbers where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        last = b"" if end_id is None else np.array([end_id], own.kind).tobytes()
        for batch in batches:
            for part in slices(batch, "t"):
                ids = [own.encode(x) + last for x in part.column(1).to_pylist()]
                size = int(own.kind[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["k", "n", "ids"])
        own.words.old, own.pieces.old = {}, {}  # the process lives on for other tasks

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, n long, ids binary")


def ranks(coded: DataFrame, kind: str, size: int) -> np.ndarray:
    """Ids by falling frequency; the vocabulary bounds what reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], names=["id", "n"])

    total = np.zeros(size, np.int64)
    for r in coded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r.id] = r.n
    return np.argsort(-total, kind="stable").astype("<u4")


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path)
    return store, at


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Write the folder ``path``; its parts in order, each with the number of ids before it."""
    spark = docs.sparkSession
    table = scratch_path(spark, "ids")
    encode(docs, tokenizer, end_id, key, text).write.option("compression", "zstd").parquet(table)
    coded = spark.read.parquet(table)
    kind, size = encoder(tokenizer).kind, encoder(tokenizer).all.get_vocab_size()
    order = ranks(coded, kind, max(size, (end_id or 0) + 1))
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order))
    total = coded.agg(F.sum("n")).first()[0] or 0

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(path)
        name = f"part-{TaskContext.get().partitionId():05d}.ids"
        temp, sink, texts, n = f"{at}/.{uuid.uuid4().hex}", None, 0, 0
        keys, ids, held = [], [], 0

        def flush() -> None:
            lengths = np.array([len(x) for x in ids], "<u4")
            values = rank_of[np.concatenate(ids)]
            control, data = pack(values)
            sink.write(struct.pack(HEAD, MAGIC, len(ids), len(values), len(data)))
            sink.write(np.array(keys, "<i8").tobytes() + lengths.tobytes() + control + data)

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if sink is None:
                    store.create_dir(at, recursive=True)
                    sink = store.open_output_stream(temp)
                v = np.frombuffer(x.as_buffer(), kind)
                if held and held + len(v) > BLOCK:
                    flush()
                    keys, ids, held = [], [], 0
                keys.append(NULL if k is None else k)
                ids.append(v)
                texts, n, held = texts + 1, n + len(v), held + len(v)
        if sink is not None:
            flush()
            sink.close()
            store.move(temp, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([texts], pa.int64()), pa.array([n], pa.int64())], names=["name", "texts", "n"])

    ordered = coded.repartitionByRange(max(1, -(-total // PART)), "k", F.crc32("ids")).sortWithinPartitions("k", "n", "ids")
    parts = sorted(ordered.select("k", "ids").mapInArrow(put, "name string, texts long, n long").collect(), key=lambda r: r.name)
    store, at = _open(path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/ranks.u32") as f:
        f.write(order.tobytes())
    out, before = [], 0
    for r in parts:
        out.append((f"{path}/{r.name}", before))
        before += r.n
    return out


def blocks(path: str, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, lengths and ids of every block of a part."""
    store, at = _open(path)
    with store.open_input_stream(at) as f:
        while head := f.read(struct.calcsize(HEAD)):
            magic, texts, n, size = struct.unpack(HEAD, head)
            if magic != MAGIC:
                raise ValueError(f"not a block of ids: {path}")
            keys, lengths = np.frombuffer(f.read(8 * texts), "<i8"), np.frombuffer(f.read(4 * texts), "<u4")
            control, data = f.read(-(-n // 4)), f.read(size)
            yield keys, lengths, order[unpack(control, data, n)]


def read(spark, path: str, parts: list[tuple[str, int]], key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every text in the files; one task for each part."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                if order is None:
                    store, at = _open(path)
                    with store.open_input_stream(f"{at}/ranks.u32") as f:
                        order = np.frombuffer(f.read(), "<u4")
                for keys, lengths, ids in blocks(name, order):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NULL), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=names)
                    start += int(ends[-1])

    names = ["k", "start", "n_tokens", "ids_crc32"]
    rows = spark.createDataFrame(parts, "name string, start long")
    return rows.repartition(max(1, len(parts))).mapInArrow(get, "k long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)
