"""Token files and byte-level BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from thermal_lake.llm import bpe, token_files

from .rows import awkward, empty

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "ß", "'s", "'LL", "12", "!!", "<|endoftext|>", "　", "日本", "the", " ing", "\x1c", "\x85", "Σ", "😀", "́", "aaaa", "\r\n", "_", "\x00", "²", "İ"]


def noise(n, size=60, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype("<u4")
    control, data = token_files.pack(values)
    assert len(control) == -(-n // 4)
    assert (token_files.unpack(control, data, n) == values).all()


def test_pieces_equal_library():
    own, library = token_files.TextEncoder(WORD), Tokenizer.from_file(WORD)
    for text in noise(1500):
        assert np.frombuffer(own.encode(text), own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, tmp_path):
    docs = awkward(spark)
    parts = token_files.write(docs, str(tmp_path / "ids"), WORD, end_id=2)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, str(tmp_path / "ids"), parts).collect())
    library, want, at = Tokenizer.from_file(WORD), [], 0
    for i, text in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i is not None, i or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert token_files.read(spark, "", token_files.write(empty(spark), str(tmp_path / "none"), WORD, end_id=2)).count() == 0


def test_bpe_equals_library():
    own, library = bpe.encoder(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(2)
    texts = noise(1500) + ["a" * k for k in range(1, 200, 7)] + [" " * k for k in range(12)] + ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 70))) for _ in range(500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got == ",".join(map(str, ids)), text
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    docs = awkward(spark)
    got = bpe.encode(docs, BYTE, ids=True).collect()
    library = Tokenizer.from_file(BYTE)
    assert len(got) == docs.count()
    texts = {(r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got} == texts
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode(empty(spark), BYTE).count() == 0


def test_bounded_memory_changes_nothing():
    own = bpe.Encoder(BYTE)
    own.words, own.tails.most, own.fits.most = bpe.Memo(own.word, 50), 50, 50
    for text in noise(300, seed=9):
        assert own.encode(text) == bpe.encoder(BYTE).encode(text)

