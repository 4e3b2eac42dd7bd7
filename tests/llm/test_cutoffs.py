"""Risk-controlled cutoffs against their definition: every level of the sequence, exact binomial tails, every cutoff's gain."""

import math
import random

from thermal_lake.llm import quality_rules as Q

VALUE = {
    "symbols": lambda r: r["n_symbols"] / r["n_words"], "upper": lambda r: r["n_upper"] / r["word_chars"], "digits": lambda r: r["n_digits"] / r["word_chars"],
    "dup_lines": lambda r: 8 * r["n_dup_lines"] / r["n_words"], "repeats": lambda r: r["n_repeat_words"] / r["n_words"], "long_words": lambda r: r["word_chars"] / r["n_words"],
    "no_short": lambda r: -r["n_short"] / r["n_words"],
}


def rows(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        good = rng.random() < 0.75
        w = rng.randint(15, 300)
        odd = (lambda share: int(w * rng.random() * share)) if rng.random() < (0.012 if good else 0.8) else (lambda share: int(w * rng.random() * share / 8))
        chars = int(w * rng.uniform(3, 9))
        out.append({"doc_id": i, "lang": rng.choice(["en", "en", "en", "de", "xx", None]), "n_words": w, "word_chars": chars, "n_symbols": odd(1.2), "n_dup_lines": odd(0.2), "n_repeat_words": odd(0.5), "n_upper": odd(2),
                    "n_digits": odd(2), "n_short": max(0, w // 3 - odd(1)), "good": good})
    return out


def plain_cutoffs(rows, marks):
    base = [r for r in rows if r["n_words"] >= 20 and 100 * r["n_repeat_words"] <= 30 * r["n_words"] and r["doc_id"] in marks]
    strata = {r["lang"] or "" for r in base}
    levels = max(len(grid) for _, grid in Q.RULES.values())
    out = {}
    for s in strata:
        own = [r for r in base if (r["lang"] or "") == s]
        good, bad = [r for r in own if marks[r["doc_id"]]], [r for r in own if not marks[r["doc_id"]]]
        last = -1
        for level in range(levels):
            hit = lambda r: any(VALUE[rule](r) > grid[level * len(grid) // levels] for rule, (_, grid) in Q.RULES.items())
            lost = sum(map(hit, good))
            if lost >= 0.05 * len(good) or sum(math.comb(len(good), i) * 0.05**i * 0.95 ** (len(good) - i) for i in range(lost + 1)) > 0.05 / len(strata):
                break
            last = level
        for rule, (_, grid) in Q.RULES.items():
            gains = [(sum(VALUE[rule](r) > c for r in bad) - 20 * sum(VALUE[rule](r) > c for r in good), -i, c) for i, c in enumerate(grid) if last >= 0 and i <= last * len(grid) // levels]
            if gains and max(gains)[0] > 0:
                out[s, rule] = max(gains)[2]
    return out


def test_cutoffs_equal_definition(spark):
    data = rows(5000, 5)
    marks = {r["doc_id"]: r["good"] for r in data if r["doc_id"] % 5}
    measured = spark.createDataFrame([(r["doc_id"], r["lang"], *[r[c] for c in Q.COUNTS]) for r in data], f"doc_id long, lang string, {Q.SHAPE}")
    labels = spark.createDataFrame([(i, int(g)) for i, g in marks.items()], "doc_id long, quality int")
    cutoffs = Q.fit(measured, labels)
    got = {(r.stratum, r.rule): r.cutoff for r in cutoffs.collect()}
    want = plain_cutoffs(data, marks)
    assert got == want and len({s for s, _ in want}) >= 2
    kept = {r.doc_id: r.kept for r in Q.judge(measured, cutoffs).collect()}
    for r in data:
        base = r["n_words"] >= 20 and 100 * r["n_repeat_words"] <= 30 * r["n_words"]
        assert kept[r["doc_id"]] == (base and not any(VALUE[rule](r) > c for (s, rule), c in want.items() if s == (r["lang"] or "")))
