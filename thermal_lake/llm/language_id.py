"""Language of documents and of spans in mixed-language text.

``train`` counts, over all labelled rows given, the byte trigrams (with word borders) and the words of each language, hashed into
a fixed number of buckets, and the scripts that its letters come from. ``label`` scores every word in every language by
its log-likelihoods, where a script range of its letters that a language hardly ever uses rules the language out for that word.
A Viterbi pass with a penalty for each switch then labels all words of a text, so a few odd words do not break a span.
The language of the text is the one with most letters in its spans.

Cases: a null text, or one without a letter, is ``und`` with score 0. Words without letters take the language around them. If no
learned language uses a text's scripts, all are alike and the most frequent one is given with a low score. Equal languages
are settled by name. Texts of any length are labelled whole. Repeated rows each get a row. With no labelled
row at all every text is ``und``. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE, mix, slices, sums_of, text_bytes, tidy, words_of

BUCKETS = 1 << 17
PENALTY = 10.0  # natural-log units that a switch of language costs
SCALE = 0.5  # overlapping trigrams count each byte more than once
RARE = 0.005  # a script with a smaller share of a language's letters is foreign to it
FOREIGN = -30.0
STEP = 64  # words that are walked one by one; such blocks of all texts are walked together
UNKNOWN = "und"

#: First code point of Unicode ranges, and the script that letters from there on belong to.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})


@lru_cache(maxsize=1)
def _letter_scripts() -> np.ndarray:
    """For every code point: 0 if it is no letter, else 1 + the number of its script."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    starts = np.array([a for a, _ in SCRIPT_RANGES])
    script = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])[np.searchsorted(starts, np.arange(0x110000), "right") - 1]
    return np.where(alpha, script + 1, 0).astype(np.uint8)


def letters_of(data: np.ndarray) -> np.ndarray:
    """At the first byte of every letter 1 + the number of its script, else 0."""
    table = _letter_scripts()
    out = table[:128][np.minimum(data, 127)]
    out[data > 127] = 0
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
        first = b[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            point = np.where(size > k, point << 6 | b[lead + k] & 0x3F, point)
        out[lead] = table[np.minimum(point, 0x10FFFF)]
    return out


@dataclass
class Grams:
    """What one slice of texts holds: words, the bucket of the trigram around each byte and of each word, letters."""

    at: np.ndarray
    s: np.ndarray
    e: np.ndarray
    trigram: np.ndarray
    word: np.ndarray
    letter: np.ndarray
    offs: np.ndarray


def grams_of(col: pa.Array) -> Grams:
    data, offs = text_bytes(col)
    w = words_of(data, offs)
    low = LOWER[data]
    low[(low >= 0x09) & (low <= 0x0D)] = 0x20
    before = np.concatenate(([0x20], low[:-1])).astype(np.uint32) if len(low) else low.astype(np.uint32)
    after = np.concatenate((low[1:], [0x20])).astype(np.uint32) if len(low) else low.astype(np.uint32)
    before[offs[:-1][offs[:-1] < len(low)]] = 0x20
    after[offs[1:][offs[1:] > 0] - 1] = 0x20
    code = before << 16 | low.astype(np.uint32) << 8 | after
    trigram = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    word = (w.hashes(lower=True) % np.uint64(BUCKETS)).astype(np.int64)
    return Grams(w.at, w.s, w.e, trigram.astype(np.int64), word, letters_of(data), offs)


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> "Model":
    """The model of all rows with a text and a language. What reaches the driver is one number for each language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                g = grams_of(part.column(0))
                langs = np.array(part.column(1).to_pylist(), object)
                for name in set(langs.tolist()):
                    own = total.setdefault(name, np.zeros(2 * BUCKETS + len(SCRIPTS) + 1, np.int64))
                    for i in np.flatnonzero(langs == name):
                        a, b = g.offs[i], g.offs[i + 1]
                        inside = g.trigram[a:b]
                        own[:BUCKETS] += np.bincount(inside, minlength=BUCKETS) if b - a > BUCKETS else 0
                        if b - a <= BUCKETS:
                            np.add.at(own, inside, 1)
                        np.add.at(own, BUCKETS + g.word[g.at[i] : g.at[i + 1]], 1)
                        own[2 * BUCKETS :] += np.bincount(g.letter[a:b], minlength=len(SCRIPTS) + 1)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "at", "n"])

    counted = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    table = counted.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique().tolist())
    counts = np.zeros((len(names), 2 * BUCKETS + len(SCRIPTS) + 1))
    counts[[names.index(x) for x in table["lang"]], table["at"].to_numpy()] = table["n"].to_numpy()
    return Model.of(names, counts)


@dataclass
class Model:
    names: list[str]
    trigram: np.ndarray  # bucket x language
    word: np.ndarray
    allowed: np.ndarray  # script x language
    prior: np.ndarray

    @classmethod
    def of(cls, names: list[str], counts: np.ndarray) -> "Model":
        def logs(c: np.ndarray) -> np.ndarray:
            p = np.log(c + 0.5) - np.log(c.sum(1, keepdims=True) + 0.5 * BUCKETS)
            return np.ascontiguousarray((SCALE * (p - p.mean(0, keepdims=True))).T.astype(np.float32))

        letters = counts[:, 2 * BUCKETS + 1 :]
        share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
        prior = letters.sum(1) / max(1.0, letters.sum())
        return cls(names, logs(counts[:, :BUCKETS]), logs(counts[:, BUCKETS : 2 * BUCKETS]), (share >= RARE).T, prior)

    def words(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Score of every word in every language, and its number of letters."""
        sums = np.zeros((len(g.trigram) + 1, len(self.names)), np.float64)
        np.cumsum(self.trigram[g.trigram], axis=0, dtype=np.float64, out=sums[1:])
        score = sums[g.e] - sums[g.s] + self.word[g.word]
        many = np.zeros(len(g.letter) + 1, np.int64)
        np.cumsum(g.letter > 0, out=many[1:])
        n = many[g.e] - many[g.s]
        score[n == 0] = 0
        bits = np.where(g.letter > 0, np.uint32(1) << np.maximum(g.letter, 1) - np.uint8(1), np.uint32(0)).astype(np.uint32)
        held = np.bitwise_or.reduceat(bits, np.stack([g.s, np.minimum(g.e, len(bits) - 1)], 1).ravel())[::2] if len(g.s) else np.zeros(0, np.uint32)
        for mask in np.unique(held):
            use = [k for k in range(len(SCRIPTS)) if mask >> np.uint32(k) & np.uint32(1)]
            ok = self.allowed[use].all(0)
            if use and not ok.all():
                score[held == mask] = np.where(ok, score[held == mask], FOREIGN) if ok.any() else 0
        return score, n


def viterbi(score: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; words at[d]:at[d+1] form text d.

    Blocks of STEP words are walked side by side, once for every language that may precede them; then the blocks of each text are
    joined from left to right, the best languages at their borders are read back, and each block is walked once more.
    """
    size = score.shape[1]
    per = -(-np.diff(at) // STEP)
    first = np.cumsum(per) - per
    total = int(per.sum())
    out = np.zeros(len(score), np.int64)
    if not total or size == 1:
        return out
    of = np.repeat(np.arange(len(per)), per)
    begin = at[:-1][of] + (np.arange(total) - first[of]) * STEP
    place = begin[:, None] + np.arange(STEP)
    real = place < at[1:][of][:, None]
    padded = np.where(real[:, :, None], score[np.where(real, place, 0)], 0.0)
    switch = -penalty * (1 - np.eye(size))
    through = np.broadcast_to(switch, (total, size, size)) + padded[:, 0][:, None]
    for t in range(1, STEP):
        through = np.maximum(through, through.max(2, keepdims=True) - penalty) + padded[:, t][:, None]
    # join the blocks of all texts, the k-th blocks together
    arrive = np.zeros((total, size))
    order = np.argsort(-per, kind="stable")
    left = per[order]
    v = np.zeros((len(per), size))
    for k in range(int(per.max())):
        docs = order[: np.searchsorted(-left, -k, "left")]
        arrive[first[docs] + k] = v[docs]
        v[docs] = (v[docs][:, :, None] + through[first[docs] + k]).max(1)
    enter, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
    last = v.argmax(1)
    for k in range(int(per.max()) - 1, -1, -1):
        docs = order[: np.searchsorted(-left, -k, "left")]
        b = first[docs] + k
        leave[b] = last[docs]
        enter[b] = (arrive[b] + through[b, :, last[docs]]).argmax(1)
        last[docs] = enter[b]
    back = np.zeros((STEP, total, size), np.int8)
    a = switch[enter] + padded[:, 0]
    for t in range(1, STEP):
        best = a.argmax(1)
        jump = a[np.arange(total), best][:, None] - penalty
        back[t] = np.where(jump > a, best[:, None], np.arange(size))
        a = np.maximum(a, jump) + padded[:, t]
    state = leave
    for t in range(STEP - 1, -1, -1):
        use = real[:, t]
        out[place[use, t]] = state[use]
        state = back[t][np.arange(total), state] if t else state
    return out


def label(docs: DataFrame, model: Model, keep: list[str], text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``keep`` columns, lang_pred, score and spans (first word, word behind the last, language) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own = held.value
        for batch in batches:
            for part in slices(batch, "_text", 4 * SLICE):
                col = part.column(len(names))
                if not own.names:
                    found = [(UNKNOWN, 0.0, [])] * len(col)
                else:
                    found = _label(own, col, penalty)
                spans = pa.array([[{"first": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), spans], names=[*names, "lang_pred", "score", "spans"])

    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text).alias("_text"))
    shape = ", ".join([*(f"{n} {t}" for n, t in src.dtypes[:-1]), "lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>"])
    return src.mapInArrow(run, shape).withColumnsRenamed(dict(zip(names, keep)))


def _label(model: Model, col: pa.Array, penalty: float) -> list[tuple[str, float, list]]:
    g = grams_of(col)
    score, letters = model.words(g)
    best = viterbi(score, g.at, penalty)
    size = len(model.names)
    weight = np.stack([sums_of(np.where(best == k, letters, 0), g.at) for k in range(size)], 1)
    whole = np.stack([sums_of_float(score[:, k], g.at) for k in range(size)], 1)
    out = []
    for i in range(len(g.at) - 1):
        a, b = int(g.at[i]), int(g.at[i + 1])
        if not weight[i].sum():
            out.append((UNKNOWN, 0.0, []))
            continue
        alike = not whole[i].any()
        k = int(model.prior.argmax()) if alike else int(weight[i].argmax())
        x = whole[i] / max(1.0, (b - a) ** 0.5)
        sure = np.exp(x - x.max())
        own = best[a:b]
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), b - a]
        share = 1.0 if alike else weight[i][k] / weight[i].sum()
        out.append((model.names[k], float(share * sure[k] / sure.sum()), [(s, e, model.names[own[s]]) for s, e in zip(cuts, cuts[1:])]))
    return out


def sums_of_float(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
