"""The parity-sketch join against all pairs."""

import random
import re

from thermal_lake.llm import jaccard_join as J

from .rows import awkward, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, k, threshold):
    sets, root = {}, {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, base, copies, share):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, int(share * len(words)))):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "a", "A b c", "a B c", "a b c d", "a b c d e"]
    for size in (7, 12, 20, 45, 100, 400):
        texts += family(rng, [f"w{rng.randrange(300)}" for _ in range(size)], 14, 0.06)
    passage = " ".join(f"p{i}" for i in range(60))  # a passage that many unlike documents share
    texts += [passage + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 120))) for _ in range(40)]
    texts += [texts[20]] * 5
    rng.shuffle(texts)
    return texts


def test_components_equal_all_pairs(spark):
    texts = corpus()
    docs = documents(spark, texts)
    for k, threshold, block in ((4, 85, J.BLOCK), (5, 80, 8), (4, 60, 6)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs, k=k, threshold=threshold, block=block).collect()}
        assert got == brute(dict(enumerate(texts)), k, threshold), (k, threshold, block)


def test_short_texts_and_skipped_bands(spark):
    """Sets of 4 to 6 shingles link at 0.8, and sets of 10 with sets of 17 to 19 at 0.5."""
    short = [" ".join(f"{x}{i}" for i in range(n)) for x in "abcdef" for n in (8, 9, 10)]
    far = [" ".join(f"{x}{i}" for i in range(n)) for x in "ghijkl" for n in (13, 20 + ord(x) % 3)]
    for texts, k, threshold in ((short, 5, 80), (far, 4, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(documents(spark, texts), k=k, threshold=threshold).collect()}
        assert got == brute(dict(enumerate(texts)), k, threshold) and len({c for _, c in got.values()}) == 6


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(docs).collect()), key=str)
    assert len(got) == docs.count()
    assert (None, 4, None) in got and (1, 0, 1) in got and (3, 0, 3) in got and got.count((0, 4, 0)) == 2 and (7, 4, 0) in got
    assert J.join(empty(spark)).count() == 0


def test_one_of_each(spark):
    docs = awkward(spark)
    left = J.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id) for r in left.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 6, None], key=str)


def test_distance_never_exceeds_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)) for _ in "ab")
        b = np.union1d(a[rng.random(len(a)) < 0.9], b[:20])
        words = min(len(J.sketch(a)), len(J.sketch(b)))
        assert np.bitwise_count(J.fold(J.sketch(a), words) ^ J.fold(J.sketch(b), words)).sum() <= len(np.setxor1d(a, b))
