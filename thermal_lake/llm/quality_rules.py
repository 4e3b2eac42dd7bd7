"""Quality rules with risk-controlled cutoffs.

``measure`` counts what the rules look at. ``fit`` learns a cutoff for each rule and stratum from labelled
holdouts. The grids of all rules are walked together, from lenient to strict, in one fixed sequence of combined rule sets
(level i holds every rule at the same share of its grid). For each level the exact binomial tail tests whether the set
rejects at most ``limit`` of the good rows, up to the first level that cannot be certified (fixed-sequence testing, so
the length of the sequence costs no power). Only strata share the error (Bonferroni). What a certified level does not reject, no
choice of its cutoffs or more lenient ones rejects either, so each rule may take any of these: with probability
``1 - error``, all rules together reject at most ``limit`` of the good rows of every stratum. Taken is the cutoff with
the best gain (bad rows caught less ``cost`` for each good row lost); a rule that catches nothing stays off.

Cases: a null or empty text has zero words and fails the base rules. A null stratum is the stratum ``""``. Strata
without enough labels (with four strata, fewer than 86 good rows) get no cutoff, so only the base rules act there. Null labels are ignored; a row labelled
more than once counts once, with its lowest label. Repeated rows each get a row of their own. Empty tables give
empty results. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.session import cut

from .common import byte_values, slices, small, span_hash, sums_of, text_bytes, tidy, windows, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_short")
SHAPE = ", ".join(f"{c} long" for c in COUNTS)

LIMIT = 0.05  # of the good rows of a stratum that all rules together may reject
ERROR = 0.05  # probability that the limit fails anywhere
COST = 20.0  # bad rows that must be caught for each good row lost

#: rule -> (SQL value, cutoffs from lenient to strict); a row is rejected when its value is above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "upper": ("n_upper / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "digits": ("n_digits / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "dup_lines": ("8 * n_dup_lines / n_words", [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3]),
    "repeats": ("n_repeat_words / n_words", [0.3, 0.28, 0.26, 0.24, 0.22, 0.2]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0]),
    "no_short": ("-n_short / n_words", [-0.0001, -0.001, -0.002, -0.005, -0.01]),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True


def _between(a: int, b: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[a : b + 1] = True
    return out


_UPPER, _DIGIT = _between(65, 90), _between(48, 57)


def repeat_words(words: list[str], k: int = 8) -> int:
    """Words that lie in a window of k words found twice or more; the exact count of one text."""
    seen: dict[tuple, int] = {}
    keys = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    for w in keys:
        seen[w] = seen.get(w, 0) + 1
    covered, end = 0, 0
    for i, w in enumerate(keys):
        if seen[w] > 1:
            covered += i + k - max(i, end)
            end = i + k
    return covered


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def _repeated(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which of n texts hold some key twice; equal keys always count, so no text is missed."""
    out = np.zeros(n, bool)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    out[d[1:][(k[1:] == k[:-1]) & (d[1:] == d[:-1])]] = True
    return out


def counts(col: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text. Hashes only find texts that may repeat something; those are counted exactly."""
    data, offs = text_bytes(col)
    w = words_of(data, offs)
    n = len(col)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    out = {
        "n_words": np.diff(w.at),
        "word_chars": sums_of(points[w.e] - points[w.s], w.at),
        "n_symbols": sums_of(_SYMBOL[data], offs),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
        "n_upper": sums_of(_UPPER[data], offs),
        "n_digits": sums_of(_DIGIT[data], offs),
        "n_short": sums_of(w.e - w.s <= 3, w.at),
    }
    breaks = np.union1d(np.flatnonzero(data == 10) + 1, offs)
    ls, le = breaks[:-1], breaks[1:]
    le = le - (data[le - 1] == 10) if len(le) else le
    has = np.searchsorted(w.s, le) > np.searchsorted(w.s, ls)
    ls, le = ls[has], le[has]
    for i in np.flatnonzero(_repeated(span_hash(byte_values(data), ls, le), np.searchsorted(offs, ls, "right") - 1, n)):
        out["n_dup_lines"][i] = dup_lines(data[offs[i] : offs[i + 1]].tobytes().decode())
    first, doc = windows(w.at, 8)
    for i in np.flatnonzero(_repeated(span_hash(w.hashes(), first, first + 8), doc, n)):
        out["n_repeat_words"][i] = repeat_words([data[s:e].tobytes() for s, e in zip(w.s[w.at[i] : w.at[i + 1]], w.e[w.at[i] : w.at[i + 1]])])
    return out


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row and COUNTS of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for part in slices(batch, "_text"):
                got = counts(part.column(part.schema.get_field_index("_text")))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=[*names, *COUNTS])

    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text).alias("_text"))
    shape = ", ".join([*(f"{n} {t}" for n, t in src.dtypes[:-1]), SHAPE])
    out = src.mapInArrow(run, shape)
    return out.withColumnsRenamed(dict(zip(names, keep)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def certified(k: int, n: int, limit: float, error: float) -> bool:
    """Whether k rejected of n good rows show that at most ``limit`` of them are: P(X <= k | limit) <= error."""
    if n == 0 or k >= n * limit:
        return False
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(limit) + (n - i) * math.log1p(-limit) for i in range(k + 1)]
    top = max(log)
    return top + math.log(sum(math.exp(x - top) for x in log)) <= math.log(error)


LEVELS = max(len(grid) for _, grid in RULES.values())
TOGETHER = ""  # name of the combined rule sets among the rules


def step_of(rule: str, level: int) -> int:
    """The step of a rule's grid that a level of the combined sequence holds."""
    return level * len(RULES[rule][1]) // LEVELS


def _choose(rows: pd.DataFrame, limit: float, error: float, cost: float) -> list[tuple[str, float]]:
    """(rule, cutoff) of one stratum, within the strictest level that the sequence certifies."""
    level = -1
    for r in rows[rows["rule"] == TOGETHER].sort_values("step").itertuples():
        if not certified(r.good_lost, r.n_good, limit, error):
            break
        level = r.step
    out = []
    for rule in RULES:
        best, cutoff = 0.0, None
        for r in rows[rows["rule"] == rule].sort_values("step").itertuples():
            gain = r.bad_caught - cost * r.good_lost
            if level >= 0 and r.step <= step_of(rule, level) and gain > best:
                best, cutoff = gain, r.cutoff
        if cutoff is not None:
            out.append((rule, cutoff))
    return out


def _out(rule: str, step: int) -> Column:
    value, grid = RULES[rule]
    return F.coalesce(F.expr(value) > F.lit(grid[step]), F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality", limit: float = LIMIT, error: float = ERROR, cost: float = COST) -> DataFrame:
    """(stratum, rule, cutoff) of every certified rule, from all labelled rows that pass the base rules."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_label"))
    one = measured.where(~base_failed()).groupBy(F.col(key).alias("_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(*(F.max(c).alias(c) for c in COUNTS))
    rows = one.join(marks, "_id")
    tests = [(rule, i, float(c), _out(rule, i)) for rule, (_, grid) in RULES.items() for i, c in enumerate(grid)]
    tests += [(TOGETHER, i, 0.0, reduce(Column.__or__, (_out(rule, step_of(rule, i)) for rule in RULES))) for i in range(LEVELS)]
    steps = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), out.alias("out")) for rule, i, c, out in tests)))
    table = rows.select("stratum", (F.col("_label") > 0).alias("good"), steps.alias("s")).select("stratum", "good", "s.*")
    n = table.groupBy("stratum", "rule", "step", "cutoff").agg(
        F.sum(F.col("good").cast("long")).alias("n_good"), F.sum((F.col("good") & F.col("out")).cast("long")).alias("good_lost"),
        F.sum((~F.col("good") & F.col("out")).cast("long")).alias("bad_caught"))
    strata = n.select("stratum").distinct().agg(F.count("*").alias("strata"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(str(pdf["stratum"].iloc[0]), *x) for x in _choose(pdf, limit, error / int(pdf["strata"].iloc[0]), cost)]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff"]).astype({"stratum": object, "rule": object, "cutoff": float})

    return n.crossJoin(F.broadcast(strata)).groupBy("stratum").applyInPandas(choose, "stratum string, rule string, cutoff double")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept."""
    per = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES))
    per = small(cut(per))
    hit = F.lit(False)
    for rule, (value, _) in RULES.items():
        hit = hit | F.coalesce(F.expr(value) > F.col(f"_cut_{rule}"), F.lit(False))
    joined = measured.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit(""))).join(per, "_stratum", "left")
    out = joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~hit})
    return out.drop("_stratum", *(f"_cut_{r}" for r in RULES))
