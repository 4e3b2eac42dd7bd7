"""Quality scores by co-training two views.

One classifier sees only shares and rates of the text, the other only metadata (source, language, length). Both start from
the labelled rows. In every round each view labels the unlabelled rows that it is sure of, and the other view learns from them as well,
at half weight. Both are logistic models, fitted by Newton steps whose gradient and curvature are sums over all rows, so nothing is
sampled: a step is one pass over a narrow table, and only sums of fixed size come to the driver. At the end each view is
calibrated on labelled rows that no step has used, and the calibrated odds are multiplied, as the views are taken for independent
given the quality.

Cases: a null or empty text has zero rates; null metadata is a value of its own. Rows without a key or label are unlabelled; a row
labelled more than once counts with its lowest label. Without labels of both kinds all scores are the share of good labels, or 0.5. Repeated
rows each get a row. Long texts are read whole. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermal_lake.session import scratch_path

from .common import slices, sums_of, text_bytes, tidy, words_of
from .quality_rules import counts

SURE = 0.95  # probability from which a view's own label goes to the other view
ROUNDS = 3
STEPS = 6  # Newton steps of a round
PSEUDO = 0.5  # weight of a pseudo-label
RIDGE = 1.0
HOLD = 5  # one labelled row in so many calibrates
SOURCES, LANGS, LENGTHS = 32, 8, 8  # hashed and binned metadata
TEXT_SIZE, META_SIZE = 20, 1 + SOURCES + LANGS + LENGTHS


def text_view(col: pa.Array) -> np.ndarray:
    """Shares and rates of every text, all between 0 and about 1."""
    c = counts(col)
    data, offs = text_bytes(col)
    w = words_of(data, offs)
    h, doc = w.hashes(lower=True), w.doc()
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(col))
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    n, chars, size = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(np.diff(offs), 1)
    of = {b: sums_of(data == ord(b), offs) for b in ".,!?|\n:;"}
    symbols, upper = c["n_symbols"] / n, c["n_upper"] / chars
    rates = [
        np.ones(len(col)), symbols > 0, np.minimum(symbols, 2), symbols > 0.25, upper, upper > 0.3, c["n_digits"] / chars, np.minimum(8 * c["n_dup_lines"] / n, 1), c["n_repeat_words"] / n,
        distinct / n, sums_of(twice, w.at) / n, chars / n / 10, c["n_short"] / n, (of["."] + of["?"]) / n, of["!"] / n, of[","] / n, np.minimum(of["|"] / n, 1), of["\n"] / n, sums_of(data > 127, offs) / size, np.minimum(np.log1p(n) / 10, 1),
    ]
    return np.stack([np.asarray(r, np.float32) for r in rates], 1)


def meta_view(source: list, lang: list, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(source), META_SIZE), np.float32)
    rows = np.arange(len(source))
    out[:, 0] = 1
    out[rows, 1 + np.array([zlib.crc32(repr(x).encode()) % SOURCES for x in source], np.int64)] = 1
    out[rows, 1 + SOURCES + np.array([zlib.crc32(repr(x).encode()) % LANGS for x in lang], np.int64)] = 1
    out[rows, 1 + SOURCES + LANGS + np.clip(np.log2(np.maximum(size, 1)).astype(np.int64) - 5, 0, LENGTHS - 1)] = 1
    return out


def features(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, y, fold, views): the label if any, and both views as one row of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for part in slices(batch, "t"):
                size = pc.fill_null(part.column(4), 0).to_numpy(zero_copy_only=False)
                both = np.concatenate([text_view(part.column(1)), meta_view(part.column(2).to_pylist(), part.column(3).to_pylist(), size)], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in both], pa.binary())], names=["id", "views"])

    kind = dict(docs.dtypes)[key]
    seen = docs.select(F.col(key).alias("id"), F.col("text").alias("t"), F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l"), F.col("n_chars").cast("long").alias("n"))
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((F.min(label) > 0).cast("int").alias("y"))
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(HOLD))
    return seen.mapInArrow(run, f"id {kind}, views binary").join(marks, "id", "left").select("id", "y", fold.cast("int").alias("fold"), "views")


def _views(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, _ = text_bytes(col)
    x = data.view(np.float32).reshape(len(col), TEXT_SIZE + META_SIZE).astype(np.float64)
    return x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(table: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of the fixed-size vectors that ``part`` makes of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        total = np.zeros(size)
        for batch in batches:
            for piece in slices(batch, "views"):
                total += part(piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for r in table.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = sigmoid(x @ w)
    return np.concatenate([x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])


def _step(w: np.ndarray, sums: np.ndarray) -> np.ndarray:
    n = len(w)
    return w - np.linalg.solve(sums[n:].reshape(n, n) + RIDGE * np.eye(n), sums[:n] + RIDGE * w)


def co_train(table: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the text view and of the metadata view."""
    text, meta = np.zeros(TEXT_SIZE), np.zeros(META_SIZE)
    sizes = [len(w) + len(w) ** 2 for w in (text, meta)]
    for r in range(rounds):
        teachers = (text.copy(), meta.copy()) if r else None
        for _ in range(STEPS):
            now = (text, meta)

            def part(batch: pa.RecordBatch, now=now, teachers=teachers) -> np.ndarray:
                views = _views(batch.column(3))
                known = np.array([-1 if v is None else v for v in batch.column(1).to_pylist()])
                train = (known >= 0) & (np.array([0 if v is None else v for v in batch.column(2).to_pylist()]) != 0)
                out = []
                for k in (0, 1):
                    y, weight = np.where(known > 0, 1.0, 0.0), train.astype(float)
                    if teachers is not None:
                        told = sigmoid(views[1 - k] @ teachers[1 - k])
                        free = (known < 0) & ((told >= sure) | (told <= 1 - sure))
                        y, weight = np.where(free, told > 0.5, y), np.where(free, PSEUDO, weight)
                    out.append(_newton(views[k], y, weight, now[k]))
                return np.concatenate(out)

            sums = _sums(table, part, sum(sizes))
            new = _step(text, sums[: sizes[0]]), _step(meta, sums[sizes[0] :])
            moved = max(np.abs(new[0] - text).max(), np.abs(new[1] - meta).max())
            text, meta = new
            if moved < 1e-4:
                break
    return text, meta


def calibrate(table: DataFrame, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Slope and offset of each view's log-odds on held-out labels, and the log-odds of a good label."""
    held = table.where(F.col("y").isNotNull() & (F.col("fold") == 0))
    good, n = table.where(F.col("y").isNotNull()).agg(F.sum("y"), F.count("y")).first()
    prior = float(np.log(((good or 0) + 0.5) / ((n or 0) - (good or 0) + 0.5)))
    a = b = np.array([0.0, 1.0])
    for _ in range(STEPS):

        def part(batch: pa.RecordBatch, a=a, b=b) -> np.ndarray:
            views, y = _views(batch.column(3)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            out = [_newton(np.stack([np.ones(len(y)), x @ w], 1), y, np.ones(len(y)), c) for x, w, c in zip(views, (text, meta), (a, b))]
            return np.concatenate(out)

        sums = _sums(held, part, 12)
        a, b = _step(a, sums[:6]), _step(b, sums[6:])
    return a, b, prior


def score(table: DataFrame, text: np.ndarray, meta: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for part in slices(batch, "views"):
                x, m = _views(part.column(1))
                zx, zm = a[0] + a[1] * (x @ text), b[0] + b[1] * (m @ meta)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.round(sigmoid(z), 6)) for z in (zx + zm - prior, zx, zm))], names=["id", "score", "text_score", "meta_score"])

    kind = dict(table.dtypes)["id"]
    return table.select("id", "views").mapInArrow(run, f"id {kind}, score double, text_score double, meta_score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """key, score, text_score, meta_score and good (score of 0.5 or more) of every row."""
    path = scratch_path(docs.sparkSession, "views")
    features(docs, labels, key, label).write.option("compression", "zstd").parquet(path)
    table = docs.sparkSession.read.parquet(path)
    text, meta = co_train(table, rounds, sure)
    out = score(table, text, meta, *calibrate(table, text, meta))
    return out.withColumnRenamed("id", key).withColumn("good", F.col("score") >= 0.5)
