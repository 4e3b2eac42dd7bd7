"""Quality rules, quality classifier, language identification and decontamination."""

import random
import re

import numpy as np
import pyarrow as pa

from thermal_lake.llm import decontamination as D
from thermal_lake.llm import language_id as L
from thermal_lake.llm import quality_classifier as C
from thermal_lake.llm import quality_rules as Q

from .rows import awkward, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w, lines, seen, dup, cover = WORD.findall(text), text.split("\n"), set(), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            cover |= {j for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts_equal_plain_form():
    rng = random.Random(4)
    texts = ["", " ", "\n\n", "a\na\n a\na", "ä|ß <> #", "\n" * 5 + "x"] + ["".join(rng.choice(["a ", "b ", "\n", "é", "| ", "\t", "x y z w v u t s r "]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    got = Q.counts(pa.array([None, *texts]))
    for i, t in enumerate(["", *texts]):
        assert tuple(int(got[c][i]) for c in Q.COUNTS[:5]) == measured(t), t


def test_exact_bound():
    assert Q.certified(0, 59, 0.05, 0.05) and not Q.certified(0, 58, 0.05, 0.05)  # 0.95^59 < 0.05 < 0.95^58
    assert Q.certified(1, 93, 0.05, 0.05) and not Q.certified(1, 92, 0.05, 0.05)
    assert not Q.certified(0, 0, 0.05, 0.05)


def labelled(spark, n=1500):
    rng = random.Random(8)
    texts, marks = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(25, 60))]
        texts.append(" ".join(w) if good else " ".join(x + "###" for x in w))
        marks.append((i, int(good), 0))
    return documents(spark, texts), spark.createDataFrame(marks[: 2 * n // 3], "doc_id long, quality int, toxic int"), [m[1] for m in marks]


def test_rules_catch_and_keep(spark):
    docs, labels, truth = labelled(spark)
    m = Q.measure(docs, ["doc_id", "lang"])
    cutoffs = Q.fit(m, labels.unionByName(labels.limit(5)))
    got = {r.doc_id: r.kept for r in Q.judge(m, cutoffs).collect()}
    assert got == {i: bool(q) for i, q in enumerate(truth)}
    none = Q.fit(m, labels.where("doc_id < 20"))  # too few labels certify nothing
    assert none.count() == 0 and all(r.kept for r in Q.judge(m, none).collect())


def test_small_strata_are_certified(spark):
    """86 good rows certify a stratum of four at no loss (0.95^86 < 0.05/4 < 0.95^85); 85 do not, and a rule that costs good rows stays lenient."""
    rng = random.Random(9)
    texts, langs, marks = [], {}, []
    for lang, n_good, n_bad in (("aa", 86, 10), ("bb", 85, 10), ("cc", 90, 10), ("dd", 120, 10)):
        for j in range(n_good + n_bad):
            w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8))) for _ in range(30)] + ["a", "an", "the"]
            if j >= n_good:
                w = [x + "###" for x in w]
            elif lang == "cc" and j < 30:  # a third of the good rows have symbols as the bad ones have, but fewer
                w = [x + "#" for x in w]
            langs[len(texts)] = lang
            marks.append((len(texts), int(j < n_good)))
            texts.append(" ".join(w))
    m = Q.measure(documents(spark, texts, langs), ["doc_id", "lang"])
    cutoffs = Q.fit(m, spark.createDataFrame(marks, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in Q.judge(m, cutoffs).collect()}
    assert {r.stratum for r in cutoffs.collect()} == {"aa", "cc", "dd"}
    assert all(kept[i] == bool(q) for i, q in marks if langs[i] != "bb") and all(kept[i] for i in langs if langs[i] == "bb")


def test_rules_awkward(spark):
    docs = awkward(spark)
    m = Q.measure(docs, ["doc_id", "lang"])
    labels = spark.createDataFrame([(0, None), (None, 1), (6, 1)], "doc_id long, quality int")
    got = Q.judge(m, Q.fit(m, labels)).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.base_failed for r in got}[6] is False and {r.doc_id: r.base_failed for r in got}[1] is True
    assert Q.judge(Q.measure(empty(spark), ["doc_id", "lang"]), Q.fit(m, labels.limit(0))).count() == 0


def test_classifier(spark):
    docs, labels, truth = labelled(spark, 600)
    got = {r.doc_id: r for r in C.classify(docs, labels).collect()}
    assert all(got[i].good == bool(q) for i, q in enumerate(truth))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_classifier_awkward(spark):
    docs = awkward(spark)
    got = C.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == docs.count() and all(r.score == 0.5 for r in got)
    assert C.classify(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        at = np.concatenate(([0], np.cumsum(rng.integers(0, 300, rng.integers(1, 6)))))
        e = rng.normal(size=(at[-1], 3)) * 3
        path = L.viterbi(e, at, 4.0)
        for a, b in zip(at, at[1:]):
            if a == b:
                continue
            v = np.zeros(3)
            for row in e[a:b]:
                v = np.maximum(v, v.max() - 4.0) + row
            own = e[np.arange(a, b), path[a:b]].sum() - 4.0 * (path[a + 1 : b] != path[a : b - 1]).sum()
            assert abs(own - v.max()) < 1e-6


ENGLISH, GREEK = "the house and the garden with that thing ", "το σπίτι και ο κήπος με αυτό το πράγμα "
GERMAN = "das haus und der garten mit dieser sache nicht "


def test_languages_and_spans(spark):
    model = L.train(spark.createDataFrame([(ENGLISH * 5, "en"), (GREEK * 5, "el"), (GERMAN * 5, "de"), (None, "en"), ("x", None)], "text string, lang string"))
    mixed = ENGLISH * 4 + GREEK * 4 + ENGLISH * 2
    got = L.label(documents(spark, [ENGLISH, GREEK, GERMAN, mixed, None, "", "123 !!", "日本"]), model, ["doc_id"])
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].lang_pred for i in range(7)] == ["en", "el", "de", "en", "und", "und", "und"]
    assert rows[7].lang_pred in ("en", "el", "de") and rows[7].score < 0.5
    assert [(s["first"], s["end"], s["lang"]) for s in rows[3].spans] == [(0, 32, "en"), (32, 68, "el"), (68, 84, "en")]
    docs = awkward(spark)
    assert L.label(docs, model, ["doc_id"]).count() == docs.count()
    assert {r.lang_pred for r in L.label(docs, L.train(empty(spark)), ["doc_id"]).collect()} == {"und"}
    assert L.label(empty(spark), model, ["doc_id"]).count() == 0


def plain_distance(p, text):
    best, prev = len(p), list(range(len(p) + 1))
    for c in text:
        cur = [0]
        for i, x in enumerate(p):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
        best = min(best, prev[-1])
    return best


def test_edits_are_found(spark):
    rng = random.Random(3)
    items = [(i, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(6, 40)))) for i in range(20)] + [(20, "short"), (21, None), (22, "")]
    texts = [None, "", "x"]
    for _ in range(120):
        p = list(rng.choice(items[:20])[1])
        for _ in range(rng.randint(0, len(p) // 12)):
            j = rng.randrange(len(p))
            p[j : j + rng.randint(0, 1)] = rng.choice(["", "q", "É", " \n"])
        texts.append("Zz  zz " + "".join(p).upper().replace("É", "é") + " zz")
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    docs = documents(spark, texts)
    want = {}
    for d, t in enumerate(texts):
        for i, x in items[:20]:
            n = plain_distance(D.plain(x).strip(), D.plain(t or ""))
            if n <= int(D.RATE * len(D.plain(x).strip())):
                want[d, i] = n
    for block in (D.BLOCK, 300):
        assert {(r.doc_id, r.item_id): r.edits for r in D.find(docs, benchmark, block=block).collect()} == want
    kept = D.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert D.find(awkward(spark), benchmark).count() == 0 and D.find(docs, benchmark.limit(0)).count() == 0 and D.clean(empty(spark), benchmark).count() == 0
