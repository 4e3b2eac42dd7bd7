"""Secrets: three fixed patterns and a battery of randomness tests, in DataFrame functions only.

Base spans come from the patterns ASSIGN, ACCESS and HEX. The battery looks at every run of 20 or more characters that tokens
are written with, whatever characters it holds; of a run that touches base spans, at the whole run and at its parts outside
them. The smallest alphabet that holds all its characters is its encoding. Three tests ask whether its characters are uniform
and independent: chi-squared over the alphabet, runs above and below the middle of the alphabet, and lag-one serial
correlation. Letters alone are written in order of their frequency in text, and a fourth test looks at their mean place: words
lie far below the middle. Letters of one case count as such from 24 characters (long words of 20 pass for random). Fisher's method joins the p-values. A run is taken for natural text where that is
rejected with the false-discovery rate held at ``rate`` within its length band (Benjamini-Hochberg over all
runs of the corpus, on a logarithmic grid of p-values, so that its state is one small table).
What stays is added as kind ``random``.

Positions are code points, found by splitting a text at a pattern: pieces and matches alternate, so running sums of
their lengths are the bounds. Matches do not overlap and are taken from the left, as regular-expression search does.

Cases: a null or empty text has no spans. Several spans may start at one place; they are ordered by kind. Repeated rows each
get a row. Very long runs are handled whole. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from thermal_lake.session import cut

from .common import small

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 or more in all: a shorter run has no longer match inside
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

RATE = 0.01
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: encoding -> (pattern of the whole run, alphabet in order, shortest length); tried from the top
ENCODINGS = {
    "decimal": (r"^[0-9]+$", "0123456789", 20),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 24),
    "letters": (r"^([a-z]+|[A-Z]+)$", COMMON, 24),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    "base36": (r"^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 24),
    "cased": (r"^[A-Za-z]+$", COMMON + COMMON.upper(), 20),
    "base64": (r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
}
FOLDED = ("hex", "letters", "base36")
RANKED = ("letters", "cased")
SHORTEST = min(least for *_, least in ENCODINGS.values())

#: Matches are walked in blocks, so that a text with very many of them costs little more than their number.
BLOCK = 256


def spans(text: str, pattern: str) -> Column:
    """Array of (s, e, m): code point bounds and characters of all matches in column ``text``; null if there are none."""
    found, pieces = f"regexp_extract_all({text}, r'{_quoted(pattern)}', 0)", f"split({text}, r'{_quoted(pattern)}', -1)"
    walk = """aggregate(part, named_struct('at', acc.at, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)), (b, x) -> named_struct(
        'at', b.at + x.p + length(x.m), 'out', concat(b.out, array(named_struct('s', b.at + x.p, 'e', b.at + x.p + length(x.m), 'm', x.m)))))"""
    outer = f"""flatten(aggregate(transform(sequence(0, (size(pairs) - 1) div {BLOCK}), i -> slice(pairs, i * {BLOCK} + 1, {BLOCK})),
        named_struct('at', 0, 'out', cast(array() as array<array<struct<s:int,e:int,m:string>>>)),
        (acc, part) -> transform(array({walk}), d -> named_struct('at', d.at, 'out', concat(acc.out, array(d.out))))[0], acc -> acc.out))"""
    pairs = f"zip_with({found}, slice(transform({pieces}, q -> length(q)), 1, size({found})), (m, p) -> named_struct('m', m, 'p', p))"
    return F.expr(f"if({text} rlike r'{_quoted(pattern)}', transform(array({pairs}), pairs -> {outer})[0], null)")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", r"\x27")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, tid (md5 of the text), the base spans (k, s, e) in order, and the runs (s, e, m): whole, but for those within base spans, and parts outside base spans."""
    src = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    raw = src.select("id", F.md5("t").alias("tid"), spans("t", ASSIGN).alias("assign"), spans("t", ACCESS).alias("access"), spans("t", HEX).alias("hex"), spans("t", RUN).alias("runs"))
    good = raw.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6))
    each = [f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS[:3])]
    base = F.expr("array_sort(concat(" + ", ".join(f"coalesce({x}, array())" for x in each) + "))")
    counted = good.withColumns({f"n_{k}": F.coalesce(F.size(F.when(F.col(k).isNotNull(), F.col(k)).otherwise(F.array())), F.lit(0)).cast("long") for k in KINDS[:3]}).withColumn("base", base)
    gap = "named_struct('s', {s}, 'e', {e}, 'm', substring(r.m, {s} - r.s + 1, {e} - {s}))"
    walk = f"""aggregate(near, named_struct('at', r.s, 'out', filter(array(r), x -> false)), (a, b) -> named_struct('at', greatest(a.at, b.e),
        'out', if(b.s > a.at, concat(a.out, array({gap.format(s='a.at', e='b.s')})), a.out)), a -> if(a.at < r.e, concat(a.out, array({gap.format(s='a.at', e='r.e')})), a.out))"""
    parts = f"transform(array({walk}), gaps -> if(size(gaps) = 0, gaps, concat(array(r), filter(gaps, x -> x.e - x.s >= {SHORTEST}))))[0]"
    split = f"flatten(transform(runs, r -> transform(array(filter(base, b -> b.s < r.e and r.s < b.e)), near -> if(size(near) = 0, array(r), {parts}))[0]))"
    return counted.withColumn("runs", F.expr(split)).drop(*KINDS[:3])


def _tail(z: str) -> str:
    """Two-sided tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    return f"least(1D, 2 * exp(-{z} * {z} / 2) / 2.5066282746310002D * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"


def battery(runs: DataFrame) -> DataFrame:
    """``runs`` (with the characters m) and their encoding, length n and joined p-value; other runs than the encodings' are dropped."""
    kind = "case " + " ".join(f"when body rlike '{pattern}' and length(body) >= {least} then '{k}'" for k, (pattern, _, least) in ENCODINGS.items()) + " end"
    alphabet = "case encoding " + " ".join(f"when '{k}' then '{a}'" for k, (_, a, _) in ENCODINGS.items()) + " end"
    steps = [
        {"body": "regexp_replace(m, '=+$', '')"},
        {"encoding": kind},
        {"a": alphabet, "body": f"if(encoding in {FOLDED}, lower(body), translate(body, '-_', '+/'))"},
        {"n": "cast(length(body) as double)", "size": "cast(length(a) as double)", "v": "transform(split(body, ''), c -> cast(locate(c, a) as double))"},
        {"squares": "aggregate(array_distinct(split(body, '')), 0D, (s, c) -> s + power(n - length(replace(body, c, '')), 2))", "avg": "aggregate(v, 0D, (s, x) -> s + x) / n",
         "highs": "aggregate(v, 0D, (s, x) -> s + if(x > size / 2 + 0.5, 1D, 0D))",
         "turns": "aggregate(zip_with(slice(v, 1, int(n) - 1), slice(v, 2, int(n) - 1), (x, y) -> if((x > size / 2 + 0.5) = (y > size / 2 + 0.5), 0D, 1D)), 1D, (s, x) -> s + x)"},
        {"cov": "aggregate(zip_with(slice(v, 1, int(n) - 1), slice(v, 2, int(n) - 1), (x, y) -> (x - avg) * (y - avg)), 0D, (s, x) -> s + x)", "var": "aggregate(v, 0D, (s, x) -> s + (x - avg) * (x - avg))",
         "chi": "(cbrt(greatest(squares * size / n - n, 0D) / (size - 1)) - (1 - 2 / (9 * (size - 1)))) / sqrt(2 / (9 * (size - 1)))", "mean": "2 * highs * (n - highs) / n + 1"},
        {"spread": "(mean - 1) * (mean - 2) / (n - 1)"},
        {"p_chi": f"if(chi > 0, {_tail('chi')} / 2, 1 - {_tail('chi')} / 2)", "z_runs": "if(spread > 0, (turns - mean) / sqrt(spread), 40D)", "z_serial": "if(var > 0, cov / var * sqrt(n), 40D)", "z_place": "(avg - (size + 1) / 2) / sqrt((size * size - 1) / 12 / n)"},
        {"x": f"-(ln(greatest(p_chi, 1e-300)) + ln(greatest({_tail('z_runs')}, 1e-300)) + ln(greatest({_tail('z_serial')}, 1e-300)) + if(encoding in {RANKED}, ln(greatest({_tail('z_place')}, 1e-300)), 0D))"},
        {"p": f"exp(-x) * (1 + x + x * x / 2 + if(encoding in {RANKED}, x * x * x / 6, 0D))"},
    ]
    out = runs
    for k, step in enumerate(steps):
        out = out.withColumns({c: F.expr(e) for c, e in step.items()})
        if k == 1:
            out = out.where(F.col("encoding").isNotNull())
    return out.select(*runs.columns, "encoding", "n", "p")


def natural(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, band, cut): runs of the family with p-values of bin ``cut`` or above are natural text.

    A bin is a step of ``-4 ln p``. A family has a few thousand bins at most, whatever the number of runs.
    """
    bins = tested.groupBy("encoding", "band", "bin").agg(F.count("*").alias("runs"))
    family = Window.partitionBy("encoding", "band")
    most = bins.withColumn("below", F.sum("runs").over(family.orderBy(F.col("bin").desc()))).withColumn("all", F.sum("runs").over(family))
    return most.where(F.col("all") * F.exp(-F.col("bin") / 4) <= rate * F.col("below")).groupBy("encoding", "band").agg(F.min("bin").alias("cut"))


def random_runs(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """(id, tid, added): spans that the battery takes for secrets; one row for each text that has some."""
    runs = scanned.where(F.size("runs") > 0).select("id", "tid", "runs").dropDuplicates(["id", "tid"]).select("id", "tid", F.inline("runs"))
    tested = battery(runs).withColumns({"band": F.floor(2 * F.log2("n")), "bin": F.least(F.floor(-4 * F.ln(F.greatest("p", F.lit(1e-300)))), F.lit(2800))})
    tested = cut(tested.drop("m"))
    kept = tested.join(natural(tested, rate), ["encoding", "band"], "left").where(F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    found = kept.groupBy("id", "tid").agg(F.collect_set(F.struct("s", F.lit(3).alias("k"), "e")).alias("added"))
    return found.withColumn("added", F.expr("filter(added, x -> not exists(added, y -> y.s <= x.s and x.e <= y.e and y != x))"))  # a part goes with its run


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """id, tid, n_assign, n_access, n_hex, and base and all: arrays of (s, k, e) by start, then kind."""
    scanned = cut(scan(docs, key, text))
    added = random_runs(scanned, rate).withColumnsRenamed({"id": "_id", "tid": "_tid"})
    out = scanned.join(added, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid")), "left")
    return out.withColumn("all", F.expr("array_sort(concat(base, coalesce(added, array())))")).select("id", "tid", *(f"n_{k}" for k in KINDS[:3]), "base", "all")


def listed(spans: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = None, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (spans that overlap become one), and the length in ``size`` set anew; other columns stay."""
    names = docs.columns
    found = cut(find(docs, key, text, rate).where(F.size("all") > 0).select(F.col("id").alias("_id"), F.col("tid").alias("_tid"), F.col("all").alias("_all")).dropDuplicates(["_id", "_tid"]))
    joined = docs.join(small(found), docs[key].eqNullSafe(F.col("_id")) & (F.md5(F.coalesce(docs[text], F.lit(""))) == F.col("_tid")), "left")
    build = f"""aggregate(_all, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> if(x.e <= a.at, a, named_struct('at', x.e,
        'out', if(x.s < a.at, a.out, concat(a.out, array(substring({text}, a.at + 1, x.s - a.at), '{mark}'))))), a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"""
    out = joined.withColumn(text, F.expr(f"if(_all is null, {text}, {build})"))
    if size:
        out = out.withColumn(size, F.expr(f"if(_all is null, {size}, length({text}))"))
    return out.select(*names)
