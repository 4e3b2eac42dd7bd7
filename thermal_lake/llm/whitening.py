"""Whitening of embeddings by singular values of the centred rows, without a covariance matrix.

Entries become integers, ``floor(scale * c) + shift``, so that their sums are exact. Each task reduces its centred rows to one upper
triangle by blockwise QR; triangles are stacked and reduced again, ``FAN`` at a time, until one R is left. Householder reflections
make R bidiagonal, dqds finds its singular values to high relative accuracy, and twisted factorisations of the bidiagonal's
tridiagonal give the vectors, which the reflections carry back. R has the table's covariance in it (R'R = n V), but its
singular values are never squared on the way. Rows are read four times and shuffled never; only triangles and sums are.

Cases: rows whose vector is null, empty, holds null, NaN or infinite entries, or has another length than most, are left out, on the
fit list and in the result. Repeated rows count as often as they occur; rows without id are kept. Directions without variance
(fewer rows than dimensions, constant or dependent columns) are numbered last, with ``whitened`` null and ``explained`` 0, and
take no part in ``identity_error``. A row with an entry beyond 2^52 after scaling has no exact integers and is left out like a
non-finite one; a deviation that does not fit a long is null. An empty table gives no rows. Equal singular values leave their vectors free within the common space; some orthonormal choice is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake.session import cut

from .vectors import matrix, usable

EPS = np.finfo(float).eps
FAN = 32
ROWS = 4096

TRIANGLE = "part long, r binary"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# Householder reduction to bidiagonal form


def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v and the first entry that x has after I - 2vv'; the others become zero."""
    norm = np.linalg.norm(x)
    alpha = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= alpha
    length = np.linalg.norm(v)
    return (v / length if length else v), alpha


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, upper diagonal and the right reflections of a square matrix."""
    m, d = r.copy(), len(r)
    right = []
    for i in range(d):
        v, m[i, i] = reflection(m[i:, i])
        m[i + 1 :, i] = 0
        m[i:, i + 1 :] -= 2 * np.outer(v, v @ m[i:, i + 1 :])
        if i + 2 < d:
            v, m[i, i + 1] = reflection(m[i, i + 1 :])
            m[i, i + 2 :] = 0
            m[i + 1 :, i + 1 :] -= 2 * np.outer(m[i + 1 :, i + 1 :] @ v, v)
            right.append(v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def carried_back(y: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Right singular vectors of the matrix (columns) from those of its bidiagonal."""
    x = y.copy()
    for i in range(len(right) - 1, -1, -1):
        v = right[i]
        x[i + 1 :] -= 2 * np.outer(v, v @ x[i + 1 :])
    return x


# differential qd with shifts


def qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One dqds transform, and the least d on its way; with a negative one the shift was too large."""
    qh, eh = np.empty_like(q), np.empty_like(e)
    d = least = q[0] - shift
    for i in range(len(e)):
        qh[i] = d + e[i]
        t = q[i + 1] / qh[i]
        eh[i] = e[i] * t
        d = d * t - shift
        if not d >= 0:
            return qh, eh, -1.0
        least = min(least, d)
    qh[-1] = d
    return qh, eh, least


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal matrix, falling. Zero shift always succeeds; larger ones are tried first."""
    q, e = a * a, b * b
    scale = max(q.max(initial=0), e.max(initial=0))
    if not scale:
        return np.zeros(len(q))
    q, e = np.maximum(q / scale, 1e-60), e / scale  # a zero on the diagonal stands for a value far below rounding
    out, gone = [], 0.0
    guess = 0.0
    while len(q):
        if len(q) == 1 or e[-1] <= EPS * EPS * (gone + q[-1]):
            out.append(gone + q[-1])
            q, e, guess = q[:-1], e[: max(0, len(q) - 2)], 0.0
            continue
        if q[0] < q[-1] / 1.5:  # graded the wrong way: the same values from the other end
            q, e = turned(q, e)
        for shift in (guess, guess / 4, 0.0):
            qh, eh, least = qd_step(q, e, shift)
            if least >= 0:
                break
        gone += shift
        # the smallest value lies in [0, least]; near convergence it is least up to the last e
        guess = max(0.0, least * (1 - 1e-10) - eh[-1]) if len(eh) and eh[-1] < 0.25 * least else least / 4
        q, e = np.maximum(qh, 1e-300), eh
    return np.sqrt(np.sort(np.array(out))[::-1] * scale)


def turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The qd array of the reversed tridiagonal, which has the same eigenvalues."""
    return q[::-1].copy(), e[::-1].copy()


# twisted factorisations


def twisted(a: np.ndarray, b: np.ndarray, value: float, choice: int = 0) -> np.ndarray:
    """Unit vector for a singular value of the bidiagonal: B'B - value^2 factored from both ends, joined where the pivot is smallest.

    ``choice`` 1, 2, ... takes the next smallest pivots, for further vectors of a multiple value.
    """
    n, lam = len(a), value * value
    pivots = a * a
    tiny = 1e-290 + EPS * EPS * pivots.max()
    ell = np.divide(b, a[:-1], out=np.zeros_like(b), where=np.abs(a[:-1]) > 0)
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -lam
    for i in range(n - 1):  # from the top: L D L' - lam = L+ D+ L+'
        dp = s[i] + pivots[i]
        dp = dp if abs(dp) > tiny else tiny
        down[i] = pivots[i] * ell[i] / dp
        s[i + 1] = down[i] * ell[i] * s[i] - lam
    p[-1] = pivots[-1] - lam
    for i in range(n - 2, -1, -1):  # from the bottom: = U- D- U-'
        dm = ell[i] * ell[i] * pivots[i] + p[i + 1]
        dm = dm if abs(dm) > tiny else tiny
        t = pivots[i] / dm
        up[i] = ell[i] * t
        p[i] = p[i + 1] * t - lam
    r = int(np.argsort(np.abs(s + p + lam), kind="stable")[choice])
    z = np.zeros(n)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vectors of the given largest values of an unreduced bidiagonal (columns); in a cluster each is made orthogonal to those before it."""
    out = np.zeros((len(a), len(values)))
    for j in range(len(values)):
        near, best = [i for i in range(j) if values[i] - values[j] <= 1e-3 * values[i]], 0.0
        for choice in range(len(a)):
            z = twisted(a, b, values[j], choice)
            for _ in range(2):
                z = z - out[:, near] @ (out[:, near].T @ z)
            if (length := np.linalg.norm(z)) > best:
                out[:, j], best = z / length, length
            if best > 0.1:
                break
    return out


def decomposed(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values, falling, and the right vectors of the largest (columns). Where an upper entry is negligible the matrix falls apart."""
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * np.sqrt(np.abs(a[:-1] * a[1:]))) + 1), len(a)]
    values, vectors = [], []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = singular_values(a[i:j], b[i : j - 1])
        z = np.zeros((len(a), min(most, j - i)))
        z[i:j] = right_vectors(a[i:j], b[i : j - 1], own[:most])
        values.append(np.stack([own, np.full(j - i, len(vectors)), np.arange(j - i)]))
        vectors.append(z)
    table = np.concatenate(values, 1)
    table = table[:, np.argsort(-table[0], kind="stable")]
    return table[0], np.stack([vectors[int(k)][:, int(c)] for _, k, c in table.T[:most]], 1)


def principal(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit directions (columns), their variances and the trace of the covariance R'R / n."""
    a, b, right = bidiagonal(r)
    values, y = decomposed(a, b, most)
    x = carried_back(y, right)
    x *= np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)  # one sign, whatever the order of rows
    return x, values[: x.shape[1]] ** 2 / n, float((values**2).sum() / n)


# over the table


def integers(x: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.floor(scale * x).astype(np.int64) + shift


def folded(parts: DataFrame, joined: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value from a table ``part``, ``r``: FAN rows at a time, in as many rounds as it takes; the order of parts is fixed."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"part": [t["part"][0].as_py() // FAN], "r": [joined(t["r"].to_pylist())]})

    while (n := parts.count()) > FAN:
        parts = cut(parts.repartition(-(-n // FAN), (F.col("part") / FAN).cast("long")).groupBy((F.col("part") / FAN).cast("long").alias("g")).applyInArrow(merge, TRIANGLE))
    rows = parts.orderBy("part").collect()
    return joined([x["r"] for x in rows]) if rows else None


def per_task(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> DataFrame:
    """One value for each task that has rows, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (r := make(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r], pa.binary())], ["part", "r"])

    return cut(rows.mapInArrow(run, TRIANGLE))


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component."""
    spark = df.sparkSession
    rows, d = usable(df, id_col, vector)
    rows = rows.where(F.forall("v", lambda c: F.abs(c * scale) <= 2.0**52))
    if not d or rows.isEmpty():
        return spark.createDataFrame([], OUT)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield part.column(0), integers(matrix(part.column(1), d), scale, shift)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in blocks(batches):
            at = np.arange(d + 1)  # the last entry counts rows
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(x.sum(0), len(x)))], ["at", "s"])

    # decimals, as sums over a large table pass the range of a long before deviations do
    total = {r["at"]: int(r["s"]) for r in rows.mapInArrow(sums, "at long, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, s = total.pop(d), np.array([total[i] for i in range(d)], object)

    def centred(x: np.ndarray) -> np.ndarray:
        whole = s // n
        return (x - whole.astype(np.int64)).astype(float) - ((s - whole * n).astype(float) / n)

    def reduced(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = None
        for _, x in blocks(batches):
            r = np.linalg.qr(centred(x) if r is None else np.vstack([r, centred(x)]), mode="r")
        return None if r is None else square(r).tobytes()

    def square(r: np.ndarray) -> np.ndarray:
        return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])

    def stacked(parts: list[bytes]) -> bytes:
        return square(np.linalg.qr(np.vstack([np.frombuffer(x).reshape(d, d) for x in parts]), mode="r")).tobytes()

    triangle = np.frombuffer(folded(per_task(rows, reduced), stacked)).reshape(d, d)
    x, variance, trace = principal(triangle, n, components)
    real = variance > (d * EPS) ** 2 * n * trace if trace else np.zeros(len(variance), bool)
    axes = x[:, real] / np.sqrt(variance[real])

    def moments(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        m = None
        for _, block in blocks(batches):
            w = centred(block) @ axes
            mean = w.mean(0)
            m = merged(m, (len(w), mean, (w - mean).T @ (w - mean)))
        return None if m is None else flat(m)

    def flat(m) -> bytes:
        return np.concatenate([[m[0]], m[1], m[2].ravel()]).tobytes()

    def merged(p, q):
        if p is None:
            return q
        k, step = p[0] + q[0], q[1] - p[1]
        return k, p[1] + step * (q[0] / k), p[2] + q[2] + np.outer(step, step) * (p[0] * q[0] / k)

    def all_moments(parts: list[bytes]) -> bytes:
        m, c = None, axes.shape[1]
        for part in parts:
            v = np.frombuffer(part)
            m = merged(m, (v[0], v[1 : c + 1], v[c + 1 :].reshape(c, c)))
        return flat(m)

    c = axes.shape[1]
    covariance = np.frombuffer(folded(per_task(rows, moments), all_moments))[c + 1 :].reshape(c, c) / n
    error = float(np.abs(covariance - np.eye(c)).max(initial=0))
    explained = np.where(real, variance / trace if trace else 0, 0.0)
    whole, rest = s // n, s % n

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(real)
        for ids, block in blocks(batches):
            w = np.full((len(block), k), np.nan)
            w[:, real] = centred(block) @ axes
            far = (block - whole.astype(np.int64)).astype(float)
            if len(block) and d * (n * (np.abs(far).max() + 1)) ** 2 < 2.0**62:
                deviation = ((n * (block - whole.astype(np.int64)) - rest.astype(np.int64)) ** 2).sum(1)
            else:  # near the limits of a long: whole numbers of any size
                deviation = [int(v) if v < 1 << 63 else None for v in ((n * block.astype(object) - s) ** 2).sum(1)]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(len(block)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))),
                pa.array(np.full(len(block) * k, n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(block)), k))), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(np.tile(explained, len(block))), pa.array(np.full(len(block) * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, OUT)
