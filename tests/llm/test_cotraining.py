"""The quality classifier against co-training written plainly over all rows at once."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from thermal_lake.llm import quality_classifier as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def noisy(n=400):
    """Good and bad documents whose signs overlap in both views."""
    rng, rows, labels = random.Random(21), [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        words = [w + ("###" if rng.random() < (0.05 if good else 0.2) else "") for w in words] + ["."] * rng.randint(0, 3)
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["web", "book", "wiki"] if good else ["web", "web", "forum", "book"]), sum(map(len, words))))
        if i % 3 < 2:
            labels.append((i, int(good if rng.random() < 0.95 else not good), 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "web", 0)]
    return rows, labels


def plain_newton(x, y, weight, w):
    grad, curve = np.array(w, float), np.eye(len(w))  # the ridge of 1
    for row, target, k in zip(x, y, weight):
        if k:
            p = 1 / (1 + math.exp(-float(row @ w)))
            grad += k * (p - target) * row
            curve += k * p * (1 - p) * np.outer(row, row)
    return w - np.linalg.solve(curve, grad)


def plain_scores(rows, labels, rounds=3, sure=0.95):
    known = {}
    for i, q, _ in labels:
        known[i] = min(q, known.get(i, q))
    views = [C.text_view(pa.array([r[1] for r in rows])).astype(float), C.meta_view([r[3] for r in rows], [r[2] for r in rows], np.array([r[4] or 0 for r in rows])).astype(float)]
    y = [known.get(r[0]) for r in rows]
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    w = [np.zeros(v.shape[1]) for v in views]
    p = lambda k, i: 1 / (1 + math.exp(-float(views[k][i] @ w_taught[k])))
    for r in range(rounds):
        w_taught = [x.copy() for x in w]
        targets = []
        for k in (0, 1):
            t, weight = [], []
            for i in range(len(rows)):
                if y[i] is not None:
                    t.append(y[i])
                    weight.append(0.0 if held[i] else 1.0)
                else:
                    told = p(1 - k, i) if r else 0.5
                    t.append(float(told > 0.5))
                    weight.append(0.5 if told >= sure or told <= 1 - sure else 0.0)
            targets.append((t, weight))
        for _ in range(6):
            new = [plain_newton(views[k], *targets[k], w[k]) for k in (0, 1)]
            moved = max(np.abs(a - b).max() for a, b in zip(new, w))
            w = new
            if moved < 1e-4:
                break
    at = [i for i in range(len(rows)) if y[i] is not None and held[i]]
    scale = [np.array([0.0, 1.0])] * 2
    for _ in range(6):
        scale = [plain_newton(np.array([[1.0, views[k][i] @ w[k]] for i in at]), [y[i] for i in at], [1.0] * len(at), scale[k]) for k in (0, 1)]
    good, n = sum(v for v in y if v is not None), sum(v is not None for v in y)
    prior = math.log((good + 0.5) / (n - good + 0.5))
    z = [[scale[k][0] + scale[k][1] * float(v @ w[k]) for v in views[k]] for k in (0, 1)]
    return {r[0]: [1 / (1 + math.exp(-v)) for v in (a + b - prior, a, b)] for r, a, b in zip(rows, *z)}


def test_scores_equal_plain_co_training(spark):
    rows, labels = noisy()
    got = C.classify(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([*labels, (3, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    want = plain_scores(rows, [*labels, (3, 0, 0), (3, 1, 1)])
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose([r.score, r.text_score, r.meta_score], want[r.doc_id], atol=2e-5), r.doc_id
        assert r.good == (r.score >= 0.5)
    pseudo = [max(v[1], 1 - v[1]) >= 0.95 for i, v in want.items() if i % 3 == 2]
    assert any(pseudo) and not all(pseudo)  # some unlabelled rows taught the other view, some did not


def test_text_rates_equal_plain_counts():
    rows, _ = noisy(40)
    texts = [r[1] for r in rows] + ["A a, B! b? 12 word word word\nline | pipe é"]
    got = C.text_view(pa.array(texts))
    for t, v in zip(texts, got):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, chars = max(1, len(w)), max(1, sum(map(len, w)))
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        want = {2: min(len(re.findall(r"[#*$%&|<>]", t)) / n, 2), 9: len(set(low)) / n, 10: sum(a == b for a, b in zip(low, low[1:])) / n, 11: chars / n / 10, 13: (t.count(".") + t.count("?")) / n,
                14: t.count("!") / n, 15: t.count(",") / n, 17: t.count("\n") / n, 18: sum(b > 127 for b in t.encode()) / max(1, len(t.encode())), 19: min(math.log1p(n) / 10, 1)}
        assert all(np.isclose(v[k], x, atol=1e-6) for k, x in want.items()), (t, want, v)
