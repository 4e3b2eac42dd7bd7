"""Small numpy kernels used inside tasks; every input is one short curve, line or matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd


def chebyshev_solver(cap: int):
    """Batch function: Chebyshev power sums to polynomial coefficients, highest power first."""

    def solve(s: pd.Series, r: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for sums, rhs, lo, hi, count in zip(s, r, a, b, n):
            deg = max(0, min(cap, int(count) - 1))
            sums, rhs = np.asarray(sums, float), np.asarray(rhs, float)
            j = np.arange(deg + 1)
            gram = (sums[j[:, None] + j] + sums[np.abs(j[:, None] - j)]) / 2
            coef = np.linalg.lstsq(gram, rhs[: deg + 1], rcond=None)[0]
            span = (lo, hi) if hi > lo else (lo - 1, lo + 1)
            poly = np.polynomial.Chebyshev(coef, domain=span).convert(kind=np.polynomial.Polynomial)
            power = np.zeros(deg + 1)
            power[: len(poly.coef)] = poly.coef
            out.append(power[::-1].tolist())
        return pd.Series(out)

    return solve


def pchip_eval(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic through (t, y) at ``at``; the end cubics continue outside."""
    t, y, at = (np.asarray(v, float) for v in (t, y, at))
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    s = np.empty_like(y)
    if len(t) == 2:
        s[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        up = d[:-1] * d[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            s[1:-1] = np.where(up, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        for e, (h0, d0, h1, d1) in ((0, (h[0], d[0], h[1], d[1])), (-1, (h[-1], d[-1], h[-2], d[-2]))):
            v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            if np.sign(v) != np.sign(d0):
                v = 0.0
            elif np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0):
                v = 3 * d0
            s[e] = v
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(h) - 1)
    u = (at - t[k]) / h[k]
    v = 1 - u
    return y[k] * v * v * (1 + 2 * u) + y[k + 1] * u * u * (3 - 2 * u) + h[k] * (s[k] * u * v * v - s[k + 1] * u * u * v)


def ssa_model(t: np.ndarray, f: np.ndarray) -> dict:
    """Linear recurrence of a factor curve from the leading modes of its lagged copies.

    Works on the last half of the curve, resampled evenly. Fewer than 12 distinct times, a flat
    curve or an unstable recurrence give the constant model.
    """
    t, f = np.asarray(t, float), np.asarray(f, float)
    keep = np.isfinite(t) & np.isfinite(f)
    t, first = np.unique(t[keep], return_index=True)
    f = f[keep][first]
    constant = dict(method="constant", t_start=float(t[-1]) if len(t) else 0.0,
                    f_start=float(np.clip(f[-1], 0, 1)) if len(t) else 1.0,
                    step=0.0, mean=0.0, window=0, rank=0, coef=[], history=[], max_step=0.0, low=0.0, high=1.0)
    if len(t) < 12 or t[-1] <= t[0]:
        return constant
    tail = t[t >= t[-1] - 0.5 * (t[-1] - t[0])]
    n = min(301, max(40, len(tail)))
    even = np.linspace(tail[0], t[-1], n)
    x = pchip_eval(t, f, even)
    window = min(min(80, max(12, n // 4)), n - 2)
    mean = x.mean()
    c = x - mean
    lagged = np.lib.stride_tricks.sliding_window_view(c, n - window + 1)
    modes, sv, _ = np.linalg.svd(lagged, full_matrices=False)
    energy = sv**2
    if not (energy > 0).any():
        return constant
    share = np.cumsum(energy) / energy.sum()
    rank = max(1, min(int(np.argmax(share >= 0.99)) + 1, 8, window - 2))
    u = modes[:, :rank]
    rest = 1 - float((u[-1] ** 2).sum())
    if rest <= 1e-8:
        return constant
    steps = np.diff(x[-(min(40, n - 1) + 1):])
    margin = max(0.01, 0.20 * float(np.ptp(x)))
    return dict(
        method="ssa", t_start=float(t[-1]), f_start=float(f[-1]), step=float(np.median(np.diff(even))), mean=float(mean),
        window=int(window), rank=int(rank), coef=(u[:-1] @ u[-1] / rest).tolist(), history=c[-(window - 1):].tolist(),
        max_step=max(1e-6, 5 * float(np.median(np.abs(steps)))), low=max(0.0, float(x.min()) - margin),
        high=min(1.0, float(x.max()) + margin))


def ssa_forecast(model: dict, t: np.ndarray) -> np.ndarray:
    """Factor at times at or after the model's start; step and level stay within its limits."""
    dt = np.maximum(0.0, np.asarray(t, float) - model["t_start"])
    if model["method"] != "ssa" or not len(dt) or dt.max() == 0:
        return np.full(len(dt), model["f_start"])
    count = max(1, int(np.ceil(dt.max() / model["step"])))
    coef, lags = np.asarray(model["coef"]), list(model["history"])
    level = [model["f_start"]]
    for _ in range(count):
        ahead = float(coef @ np.asarray(lags[-len(coef):])) - (level[-1] - model["mean"])
        nxt = level[-1] + float(np.clip(ahead, -model["max_step"], model["max_step"]))
        nxt = float(np.clip(nxt, model["low"], model["high"]))
        level.append(nxt)
        lags.append(nxt - model["mean"])
    return np.interp(dt, np.arange(count + 1) * model["step"], level)


def parabola_pass(values: np.ndarray) -> np.ndarray:
    """Row-wise lower envelope: out[r, i] = min over j of (i - j)^2 + values[r, j].

    The parabolas that are lowest somewhere are kept on a stack per row, with the place where each takes over from the one before; rows
    are worked on together, so the cost grows with the length of a row.
    """
    rows, n = values.shape
    f = values.astype(float, copy=False)
    top, on = np.zeros(rows, np.int64), np.arange(rows)
    apex, start = np.zeros((rows, n), np.int64), np.full((rows, n + 1), np.inf)
    start[:, 0] = -np.inf
    for j in range(1, n):
        at, take = np.empty(rows), on
        while len(take):
            v = apex[take, top[take]]
            at[take] = ((f[take, j] + j * j) - (f[take, v] + v * v)) / (2 * (j - v))
            take = take[at[take] <= start[take, top[take]]]
            top[take] -= 1
        top += 1
        apex[on, top], start[on, top] = j, at
        start[on, top + 1] = np.inf
    out, k = np.empty(values.shape), np.zeros(rows, np.int64)
    for i in range(n):
        move = on[start[on, k + 1] < i]
        while len(move):
            k[move] += 1
            move = move[start[move, k[move] + 1] < i]
        v = apex[on, k]
        out[:, i] = (i - v) ** 2 + f[on, v]
    return out


def line_pass(values: np.ndarray, start: np.ndarray, step: np.ndarray, length: np.ndarray, far: float) -> np.ndarray:
    """:func:`parabola_pass` along many lines of a flat array, each given by its first position, step and length.

    Lines of about one length (within a factor of two) are worked on together, filled up with ``far``.
    """
    filled, out = np.append(values, far), values.copy()
    kind = np.ceil(np.log2(np.maximum(length, 1)))
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        i = np.arange(length[rows].max(initial=0))
        real = i < length[rows, None]
        at = np.where(real, start[rows, None] + i * step[rows, None], len(values))
        out[at[real]] = parabola_pass(filled[at])[real]
    return out


def block_components(block: np.ndarray, place: list[np.ndarray], side: int, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """Component of each occupied cell of many blocks at once: the position, in (block, x, y, z) order, of its first cell.

    ``place`` holds x, y, z of the cells within their blocks, 0 .. ``side`` - 1; cells must be given in that order. Neighbours are
    found by binary search, and components are joined at their smallest members until nothing changes.
    """
    pad = side + 2  # an empty rim, so that steps out of a block meet nothing
    code = ((block * pad + place[0] + 1) * pad + place[1] + 1) * pad + place[2] + 1
    a, b = [], []
    for dx, dy, dz in offsets:
        if (dx, dy, dz) > (0, 0, 0):
            want = code + (dx * pad + dy) * pad + dz
            at = np.minimum(np.searchsorted(code, want), max(0, len(code) - 1))
            hit = np.flatnonzero(code[at] == want) if len(code) else at
            a.append(hit)
            b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(code))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]  # a pair under one root stays there
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root

