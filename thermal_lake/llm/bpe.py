"""Byte-level BPE by dynamic programming over prefixes, exact in both directions.

Greedy merging need not be replayed. If the encoding of every prefix of a word is known, the last token of the next prefix
is the one token that ends there, encodes to itself, and is compatible with the last token of the prefix before it: there is
exactly one. An automaton over all tokens reports the tokens that end at each place. Two tokens are compatible if encoding
their joined characters gives these two tokens again; that is seen from the right edge of the first token's merge tree and
the left edge of the second's. The stored last tokens are back-pointers, read from the end of the word.

Cases: a null or empty text has no tokens and decodes to the empty text. Special tokens found in a text get their own ids. Words
of any length are encoded whole, in time linear in their length. Repeated rows each get a row. Empty tables give
empty results. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMORIES, slices

#: White space and the word pattern of the byte-level pre-tokenizer.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space in which cutting before every space would change the words.
UNCUT = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")
#: Words and pairs of tokens remembered in a worker process, twice as many at most: some 50 MB each.
CACHE, PAIRS = 200_000, 300_000
MARKS = frozenset(".,;:!?")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: its own if it is printable Latin-1, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """A bounded memory of a function of one key. When it is full, what is used again is kept and the rest forgotten."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Tails(Memo):
    """Ids of what follows a space. A word with a mark behind it, and what spans lines, is put together from words and not remembered."""

    def __init__(self, own: Encoder):
        super().__init__(lambda piece: own.word(" " + piece) if piece.isalpha() else own.piece(" " + piece))
        self.own = own

    def __missing__(self, key):
        if key[-1:] in MARKS and key[:-1].isalpha():
            return f"{self[key[:-1]]},{self.own.words[key[-1]]}"
        if "\n" in key:
            first, _, rest = key.partition("\n")
            if first and rest and not rest[0].isspace() and not first[-1].isspace():  # a single line break is a word of its own
                return f"{self[first]},{self.own.words[chr(10)]},{self.own.lines(rest)}"
            return self.own.piece(" " + key)
        return super().__missing__(key)


class Encoder:
    """Encodes and decodes texts with the vocabulary of one tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cutter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        self.blank = letters[32]
        byte = {c: b for b, c in enumerate(letters)}
        self.names = {i: str(i) for i in vocab.values()}
        self.bytes = {str(i): bytes(byte[c] for c in t) for t, i in vocab.items()} | {str(i): t.encode() for t, i in self.special.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a], vocab[b]] = rank
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], rank))
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.fits = Memo(lambda pair: self._apart(pair >> 32, pair & 0xFFFFFFFF, len(self.pairs)), PAIRS)
        self.automaton = ahocorasick.Automaton()
        whole = {i: i not in self.parts for i in vocab.values()}
        for token, (a, b, rank) in sorted(self.parts.items(), key=lambda x: x[1][2]):
            whole[token] = whole[a] and whole[b] and self._apart(a, b, rank)
        for t, i in vocab.items():
            if whole[i]:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.words, self.tails = Memo(self.word), Tails(self)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens on one edge of the merge tree from the byte up, each with the rank at which it is merged into the next."""
        known = (self.left, self.right)[side]
        if token not in known:
            out, rank, at = [], len(self.pairs), token
            while True:
                out.append((at, rank))
                if at not in self.parts:
                    break
                rank, at = self.parts[at][2], self.parts[at][side]
            known[token] = out[::-1]
        return known[token]

    def _apart(self, a: int, b: int, end: int) -> bool:
        """Whether tokens a and b form side by side without a merge across their border before rank ``end``."""
        one, two = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_next), (y, y_next) = one[i], two[j]
            last = i == len(one) - 1 and j == len(two) - 1
            across = self.pairs.get((x, y))
            if last:
                return across is None or across >= end
            # equal ranks merge from the left: the left tree's next merge goes before the border, the right tree's after it
            if across is not None and across < x_next and across <= y_next:
                return False
            if j == len(two) - 1 or i < len(one) - 1 and x_next <= y_next:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        return self.fits[a << 32 | b]

    def word(self, word: str) -> str:
        """Ids of one word of the pre-tokenizer, as decimal numbers joined by commas."""
        if word.isascii() and word.isprintable():
            text = word.replace(" ", self.blank)
        else:
            text = "".join(map(self.letters.__getitem__, word.encode()))
        last, back, fits = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.fits
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    before = last[start]
                    if before < 0 or not fits[before << 32 | token]:
                        continue
                last[end], back[end] = token, start
        at, names = len(text), self.names
        if not at:
            return ""
        out, at = names[last[at]], back[at]
        while at:
            out, at = f"{names[last[at]]},{out}", back[at]
        return out

    def lines(self, rest: str) -> str:
        """What stands at the beginning of a line."""
        if rest.isalpha():
            return self.words[rest]
        if rest[-1:] in MARKS and rest[:-1].isalpha():
            return f"{self.words[rest[:-1]]},{self.words[rest[-1]]}"
        return self.piece(rest)

    def piece(self, piece: str) -> str:
        return ",".join(map(self.words.__getitem__, WORD.findall(piece)))

    def _plain(self, text: str) -> str:
        """A text without special tokens; cut before spaces, where that leaves the words as they are."""
        if UNCUT.search(text):
            return self.piece(text)
        head, *tails = text.split(" ")
        out = ",".join(map(self.tails.__getitem__, tails))
        return f"{self.piece(head)},{out}" if head and out else out or self.piece(head)

    def encode(self, text: str | None) -> str:
        """All ids as decimal numbers joined by commas."""
        if not text:
            return ""
        parts = self.cutter.split(text) if self.cutter else [text]
        return ",".join(str(self.special[p]) if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def decode(self, ids: str) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.split(","))).decode("utf8", "replace") if ids else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    return Encoder(path)


MEMORIES.append(encoder.cache_clear)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row and, if asked for, the ids themselves."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, "t"):
                coded = [own.encode(x) for x in part.column(1).to_pylist()]
                cols = [
                    part.column(0), pa.array([x.count(",") + 1 if x else 0 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in coded]),
                ]
                if ids:
                    cols.append(pa.array([[int(i) for i in x.split(",")] if x else [] for x in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        own.words.old, own.tails.old, own.fits.old = {}, {}, {}  # the process lives on for other tasks

    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    shape = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, shape).withColumnRenamed("k", key)
