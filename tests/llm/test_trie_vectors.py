"""Prefix trie, whitening and multi-index, each against a plain form of its definition."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermal_lake.llm import multi_index as M
from thermal_lake.llm import prefix_trie as T
from thermal_lake.llm import whitening as W

TURNS = "conv_id long, turn long, role string, text string, conv long, pos long, id string, len string, key long, j long"
VECTORS = "vec_id long, embedding array<float>, id long, v string, cell string, rep string, label int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, -1, -1, "x", "y", -1, -1) for r in rows], TURNS)


def sequences(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    return {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}


def plain_trie(seq):
    members, kids, total = defaultdict(list), defaultdict(list), {}
    for c, s in sorted(seq.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        below = [total[x] for x in kids[k]]
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        total[k] = (sum(b[0] for b in below) if below else 1, sum(b[1] for b in below) + own)
    return {(m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), *total[k],
             hashlib.sha256(",".join(str(c) for c in m if len(seq[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()}


def test_trie_equals_plain_form(spark):
    rng = random.Random(3)
    rows = []
    for c in range(-7, 60):
        n, shared = rng.choice([0, 1, 2, 5, 8, 9, 16, 17, 40]), rng.choice(["a", "b"])
        rows += [(c, t, rng.choice(["user", "assistant", None]) if t > 30 else "user", rng.choice([f"{shared}{t}", f"{shared}{t}", "é", None, ""])) for t in range(n)]
    rows += [(100, None, "u", "first"), (100, 3, "u", "x"), (100, 3, "u", "x"), (100, 3, "u", "w"), (None, 0, "u", "nobody's"), (100, 0, "u" * 3, "q"), (101, 0, "", "uuuq")]
    got = T.trie(T.whole(T.positions(turns(spark, rows))))
    assert {tuple(r) for r in got.collect()} == plain_trie(sequences(rows)) and got.count() == len(plain_trie(sequences(rows)))


def test_trie_goes_deep_and_ranks_hot_conversations_in_ranges(spark):
    deep = [(f"t{i % 3}", "x" * (i % 5)) for i in range(700)]  # the second ends earlier, the third leaves after 520 turns
    seq = {5: deep, 6: deep[:64], 7: deep[:520] + [("u", "other")] * 80, 8: deep[:64], 9: deep[:63], 10: deep[:512]}
    rows = [(c, t, *x) for c, s in seq.items() for t, x in enumerate(s)]
    random.Random(1).shuffle(rows)
    df = turns(spark, rows)
    ranged = T.positions(df, rows=50)
    assert {tuple(r) for r in ranged.collect()} == {tuple(r) for r in T.positions(df).collect()}
    assert {tuple(r) for r in T.trie(T.whole(ranged)).collect()} == plain_trie(seq)


def test_trie_of_regrafted_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, "user", rng.choice("abc") * t) for c in [*range(-6, 40), 42, 43, 51, *range(101, 130, 5)] for t in range(rng.choice([1, 2, 3, 8, 12, 30]))]
    own = sequences(rows)
    seq = {}
    for c, s in own.items():
        h, source = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        seq[c] = own.get(source, [])[:h] + s[h:]
    conv = F.col("conv")
    items = T.regrafted(T.positions(turns(spark, rows)), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    assert any(not s for s in seq.values())  # some are left without a turn
    assert {tuple(r) for r in T.trie(items).collect()} == plain_trie(seq)


def test_end_hash_over_many_ranges(spark):
    ids = [*range(-3, 4), *range(8190, 8195), 10**6, 10**12]
    root = T.trie(T.whole(T.positions(turns(spark, [(c, 0, "u", "same") for c in ids])))).where("depth = 1").first()
    assert root.n_convs == len(ids) and root.saved_tokens == 4 * (len(ids) - 1)
    assert root.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def test_trie_of_nothing(spark):
    assert T.trie(T.whole(T.positions(turns(spark, [])))).count() == 0
    assert T.trie(T.whole(T.positions(turns(spark, [(None, 1, "u", "x")])))).count() == 0


def vectors(spark, xs, ids=None):
    rows = [(i, None if x is None else [None if c is None else float(c) for c in x], -1, "x", "y", "z", 0) for i, x in zip(ids if ids is not None else range(len(xs)), xs, strict=True)]
    return spark.createDataFrame(rows, VECTORS)


AWKWARD = [None, [], [1.0, None, 2.0, 0.0], [float("nan")] * 4, [0.0, float("inf"), 0.0, 0.0], [1.0, 2.0]]


@pytest.mark.parametrize("a", [
    np.random.default_rng(0).normal(size=(300, 40)), np.random.default_rng(1).normal(size=(5, 12)), np.zeros((4, 3)), np.ones((3, 1)), 3 * np.eye(9),
    np.repeat(np.random.default_rng(2).normal(size=(40, 3)), 3, axis=1), np.random.default_rng(3).normal(size=(90, 25)) * 10.0 ** -np.arange(25),
    np.vstack([np.eye(8) * 2, np.eye(8), np.diag([1, 1, 1, 3, 3, 3, 5, 5.0])]), np.linalg.qr(np.random.default_rng(4).normal(size=(90, 30)))[0],
])
def test_singular_values_and_vectors(a):
    d = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    ref = np.sqrt(np.maximum(np.linalg.eigvalsh(a.T @ a)[::-1], 0))
    aa, bb, _ = W.bidiagonal(r)
    values, _ = W.decomposed(aa, bb, d)
    x, variance, trace = W.principal(r, len(a), min(8, d))
    assert np.allclose(values, np.pad(np.linalg.svd(a, compute_uv=False), (0, max(0, d - len(a))))[:d], atol=1e-13 * (1 + ref[0]))
    assert np.allclose(a.T @ (a @ x) / len(a), x * variance, atol=1e-12 * (1 + variance[0])) and np.isclose(trace, (a * a).sum() / len(a))
    real = variance > 1e-12 * (trace or 1)
    assert np.allclose(x[:, real].T @ x[:, real], np.eye(real.sum()), atol=1e-12)


def test_dqds_keeps_small_values_accurate():
    a, b = 10.0 ** -np.arange(12.0), 0.5 * 10.0 ** -np.arange(1, 12.0)
    values = W.singular_values(a, b)
    assert np.isclose(np.prod(values / a), 1, rtol=1e-12)  # the product of all is that of the diagonal
    inverse = np.linalg.svd(np.linalg.inv((np.diag(a) + np.diag(b, 1)).astype(np.longdouble).astype(float)), compute_uv=False)
    assert np.isclose(values[-1], 1 / inverse[0], rtol=1e-10)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(7)
    xs = [list(v.astype(np.float32)) for v in rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))]
    xs += [xs[0], xs[0], *AWKWARD]
    ids = [*range(200), 0, None, *range(300, 300 + len(AWKWARD))]
    out = W.whiten(vectors(spark, xs, ids).repartition(7), components=3).toPandas()
    x = np.floor(1024 * np.array(xs[:202], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    want = c @ u[:, :3] / np.sqrt(e[:3])
    assert len(out) == 3 * n and set(out.n) == {n} and out.identity_error.max() < 1e-10 and out.vec_id.isna().sum() == 3
    one = out[out.vec_id == 17].sort_values("component")
    many = out[out.vec_id.between(1, 199)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((many * want[1:200]).sum(0))
    assert np.allclose(many * sign, want[1:200], atol=1e-9) and np.allclose(one.explained, e[:3] / e.sum(), rtol=1e-10)
    assert set(one.deviation) == {int(((n * x[17] - s) ** 2).sum())}


def test_whitening_without_variance(spark):
    assert W.whiten(vectors(spark, [])).count() == 0 and W.whiten(vectors(spark, AWKWARD[:2])).count() == 0
    flat = W.whiten(vectors(spark, [[1.0, 2.0]] * 3)).toPandas()
    assert len(flat) == 6 and flat.whitened.isna().all() and (flat.explained == 0).all() and (flat.identity_error == 0).all() and (flat.deviation == 0).all()
    line = W.whiten(vectors(spark, [[1.0, 0.0], [3.0, 0.0], [1e30, 0.0]])).toPandas()
    assert set(line.n) == {2} and sorted(line[line.component == 1].whitened.round(9)) == [-1, 1] and line[line.component == 2].whitened.isna().all()


def test_triangles_are_folded_in_rounds(spark):
    r = np.random.default_rng(9).normal(size=(5, 3, 3))
    parts = spark.createDataFrame([(i, bytearray(np.triu(x).tobytes())) for i, x in enumerate(r) for _ in range(1)], W.TRIANGLE)
    old, W.FAN = W.FAN, 2
    try:
        got = np.frombuffer(W.folded(parts, lambda p: np.linalg.qr(np.vstack([np.frombuffer(x).reshape(3, 3) for x in p]), mode="r").tobytes())).reshape(3, 3)
    finally:
        W.FAN = old
    whole = np.vstack([np.triu(x) for x in r])
    assert np.allclose(got.T @ got, whole.T @ whole)


def test_walk_yields_falling_sums():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(-3, 4, rng.integers(1, 9)).astype(float), rng.normal(size=rng.integers(1, 9))
        walk = list(M.traverse(a, b))
        sums = (a[:, None] + b[None]).ravel()[walk]
        assert sorted(walk) == list(range(len(walk))) and len(walk) == len(a) * len(b) and (np.diff(sums) <= 1e-12).all()


def test_cells_are_laid_in_blocks():
    sizes = np.array([0, 10, 5000, 4090, 10, 0, 4096, 9000])
    start, parts = M.blocks(sizes)
    assert list(parts) == [1, 1, 2, 1, 1, 1, 1, 3]
    filled = defaultdict(list)
    for cell, (s, p) in enumerate(zip(start, parts, strict=True)):
        for b in range(s, s + p):
            if sizes[cell]:
                filled[b].append(cell)
    assert all(len(c) == 1 or sizes[c].sum() <= M.BLOCK for c in filled.values()) and all(len(filled[b]) == 1 for b in (start[2], start[2] + 1, start[7] + 2))


def brute(xs, ids, k):
    x = np.array(xs, float)
    out = {}
    for q in np.flatnonzero(np.array(ids) % 20 == 0):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


def found(spark, xs, ids, **more):
    entries, book = M.build(vectors(spark, xs, ids))
    out = defaultdict(list)
    for r in M.search(entries, book, lambda i: i % 20 == 0, **more).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_search_reaches_recall(spark):
    rng = np.random.default_rng(4)
    xs = [list(v / np.linalg.norm(v)) for v in (rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]).astype(np.float32)]
    want, got = brute(xs, list(range(3000)), 20), found(spark, xs, list(range(3000)))
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) >= 0.9
    full = found(spark, xs, list(range(3000)), recall=1.0)  # every probe, here every query, finds all of its own
    assert {q: [i for i, _ in v] for q, v in full.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_search_with_copies_ties_and_few_candidates(spark):
    xs = [[1.0, 0.0, 0.0, 0.5]] * 70 + [[0.0, 1.0, 0.0, 0.0]] * 3 + [[-1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 2.0, 0.0]]
    ids = list(range(len(xs)))
    assert found(spark, xs, ids, recall=1.0) == brute(xs, ids, 20)
    xs, ids = [[1.0, 2.0], [2.0, 1.0], [2.0, 1.0], [-1.0, 0.0]], [20, 40, 7, 60]
    assert found(spark, xs, ids, recall=1.0) == brute(xs, ids, 20)
    awkward = [*AWKWARD[:-1], [1.0, 2.0, 3.0], [0.0, -0.0], [1.0, 1.0]]
    assert found(spark, [*xs, *awkward, xs[0]], [*ids, *range(100, 100 + len(awkward) - 1), None, 20], recall=1.0) == brute(xs, ids, 20)


def test_large_cells_are_searched_in_blocks(spark):
    rng = np.random.default_rng(6)
    xs = [list(v.astype(np.float32)) for v in rng.normal(size=(400, 4)) * [1e-3, 1e-3, 1, 1e-3] + [1, 0, 0, 0]]
    old, M.BLOCK = M.BLOCK, 32
    try:
        got = found(spark, xs, list(range(400)), recall=1.0)
    finally:
        M.BLOCK = old
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in brute(xs, list(range(400)), 20).items()}


def test_search_of_nothing(spark):
    assert found(spark, [], []) == {} and found(spark, [[0.0, 0.0]], [20]) == {} and found(spark, [[1.0, 0.0]], [20]) == {} and found(spark, [[1.0, 0.0]], [3]) == {}
