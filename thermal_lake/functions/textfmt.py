"""Number formats, name sanitising, numeric tokens, labels and truthiness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, extract, text


def g(c: Column | str) -> Column:
    """Shortest six-digit decimal text of a number, as C's ``%g`` writes it."""
    c = col(c).cast("double")
    sci = F.format_string("%.5e", c)
    exponent = F.regexp_extract(sci, r"e([-+]\d+)$", 1).cast("int")
    strip = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = strip(sci.cast("decimal(38,12)").cast("string"))
    mantissa = strip(F.regexp_extract(sci, r"^([^e]+)", 1))
    sign = F.when(exponent < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(c.isNull(), None).when(c == 0, F.lit("0")).when(
        exponent.between(-4, 5), plain).otherwise(scientific)


def g_path(c: Column | str) -> Column:
    """``g`` with the decimal point written as ``p``, for folder names."""
    return F.replace(g(c), F.lit("."), F.lit("p"))


@dataclass(frozen=True)
class NameRule:
    """How one family of names is cleaned."""

    forbidden: str
    keep_runs: bool = False
    trim: bool = True
    lower: bool = False
    max_len: int | None = None
    empty: str | None = None
    prefix: str | None = None
    prefix_unless: str = r"^[a-zA-Z]"
    drop_lead: str | None = None
    drop_tail: str | None = None


# The name families of the archive and their limits.
NAME_RULES = {
    "partition": NameRule(r"[^\w.-]+"),
    "tag": NameRule(r"[^a-zA-Z0-9_]", trim=False, prefix="T_"),
    "segment": NameRule(r"[^a-zA-Z0-9_-]+", empty="desconocido"),
    "file24": NameRule(r"[^\w]+", lower=True, max_len=24, empty="datos"),
    "file32": NameRule(r"[^\w]+", lower=True, max_len=32, empty="datos"),
    "file48": NameRule(r"[^\w]+", lower=True, max_len=48, empty="datos"),
    "correction": NameRule(r"[^\w]+", lower=True, max_len=72, empty="correccion", drop_lead="corr_"),
    "field": NameRule(r"[^a-zA-Z0-9_]", keep_runs=True, trim=False, prefix="m_",
                      prefix_unless=r"^[^0-9]", drop_tail=r"(?i)\.mph$", empty="modelo_sin_nombre"),
}


def sanitize(c: Column | str, rule: str | NameRule) -> Column:
    """P5: clean a name by one of ``NAME_RULES``."""
    r = NAME_RULES[rule] if isinstance(rule, str) else rule
    s = F.coalesce(col(c), F.lit(""))
    if r.drop_tail:
        s = F.regexp_replace(s, r.drop_tail, "")
    s = F.regexp_replace(s, r.forbidden, "_")
    if r.lower:
        s = F.lower(s)
    if not r.keep_runs:
        s = F.regexp_replace(s, "_+", "_")
    if r.trim:
        s = F.regexp_replace(s, "^_+|_+$", "")
    if r.drop_lead:
        s = F.regexp_replace(s, "^" + r.drop_lead, "")
    if r.max_len:
        s = F.when(F.length(s) > r.max_len,
                   F.regexp_replace(F.substring(s, 1, r.max_len), "_+$", "")).otherwise(s)
    if r.empty is not None:
        s = F.when(s == "", F.lit(r.empty)).otherwise(s)
    if r.prefix:
        s = F.when(s.rlike(r.prefix_unless), s).otherwise(F.concat(F.lit(r.prefix), s))
    return s


# The units that a short tag keeps, in its order.
SHORT_UNITS = ("ant", "w", "min")


def short_correction_tag(c: Column | str) -> Column:
    """``4ant_30w_15min_z4_r2`` from the numbers in a name, else the first 32 characters."""
    raw = sanitize(c, NameRule(r"[^\w]+", lower=True))
    words = F.split(raw, "_")

    def before(unit: str) -> Column:
        """First digits with the unit behind them, in one word or at the start of the next word."""
        counts = F.transform(words, lambda w, i: F.coalesce(extract(w, rf"(\d+){unit}"), F.when(F.get(words, i + 1).startswith(unit), extract(w, r"(\d+)$"))))
        return F.get(F.filter(counts, lambda v: v.isNotNull()), 0)

    zones = F.get(F.filter(F.transform(words, lambda w: extract(w, r"zonas?(\d+)")), lambda v: v.isNotNull()), 0)
    revision = F.when(F.size(words) > 1, extract(F.element_at(words, -1), r"^(\d+)$"))
    named = [(before(u), "", u) for u in SHORT_UNITS] + [(zones, "z", ""), (revision, "r", "")]
    joined = F.concat_ws("_", *[F.concat(F.lit(pre), v, F.lit(post)) for v, pre, post in named])
    plain = F.substring(F.when(raw.startswith("corr_"), F.substring(raw, 6, 1 << 20)).otherwise(raw), 1, 32)
    tag = F.rtrim(F.coalesce(text(joined), plain), F.lit("_"))
    return F.coalesce(text(tag), F.lit("correccion"))


def decimal_token(c: Column | str) -> Column:
    """Number from text whose decimal mark is ``.`` or ``p``."""
    return F.replace(F.lower(col(c)), F.lit("p"), F.lit(".")).try_cast("double")


def number_in_text(c: Column | str) -> Column:
    """P10: the first number anywhere in the text."""
    return decimal_token(extract(F.lower(col(c)), r"([-+]?\d+(?:[p.]\d+)?)"))


def labelled_number(c: Column | str, kind: str) -> Column:
    """P10: ``caso_3``, ``c3``, ``potencia_12p5W``, ``p30`` and the like to numbers."""
    s = F.replace(F.lower(col(c)), F.lit(" "), F.lit(""))
    if kind == "caso":
        s = F.regexp_replace(s, "^(caso_|caso|c)", "")
    elif kind == "potencia":
        s = F.regexp_replace(F.regexp_replace(s, "^(potencia_|potencia|p)", ""), "w$", "")
    return F.replace(s, F.lit("p"), F.lit(".")).try_cast("double")


def label(*parts: Column) -> Column:
    """Non-empty parts joined by a spaced pipe."""
    return F.concat_ws(" | ", *[text(p) for p in parts])


# Words that count as true.
TRUE_WORDS = ("1", "true", "si", "yes")


def truthy_text(c: Column | str) -> Column:
    """P12 for text."""
    return F.coalesce(F.lower(col(c)).isin(*TRUE_WORDS), F.lit(False))


def truthy_number(c: Column | str) -> Column:
    """P12 for numbers."""
    return F.coalesce(col(c) != 0, F.lit(False))


def int_range(start: Column, stop: Column, step: Column) -> Column:
    """Start, start+step, ... and the stop itself; NULL when start exceeds stop."""
    step = F.greatest(F.lit(1), step)
    full = F.array_distinct(F.concat(F.sequence(start, F.greatest(start, stop), step), F.array(stop)))
    return F.when(start <= stop, full)


def int_list(c: Column | str, low: int, high: int) -> Column:
    """Comma, semicolon or blank separated integers in first-seen order.

    Empty text and ``todos`` mean "all" (NULL); a list with a value outside the bounds is NULL
    as a whole and is told apart by ``int_list_valid``.
    """
    s = F.trim(col(c))
    numbers = F.transform(F.split(s, r"[,;\s]+"),
                          lambda v: F.round(v.try_cast("double")).cast("int"))
    numbers = F.array_distinct(F.array_compact(numbers))
    ok = F.forall(numbers, lambda v: v.between(low, high))
    return F.when((s != "") & (F.lower(s) != "todos") & (F.size(numbers) > 0) & ok, numbers)


def text_list(c: Column | str) -> Column:
    """Comma, semicolon or line separated words, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(col(c), r"[,;\n]+"), F.trim), lambda v: v != "")


def time_list(c: Column | str) -> Column:
    """Sorted distinct minutes; NULL for "all"."""
    s = F.trim(col(c))
    numbers = F.array_compact(F.transform(F.split(s, r"[,\s]+"), lambda v: v.try_cast("double")))
    return F.when((s != "") & (F.lower(s) != "todos"), F.array_sort(F.array_distinct(numbers)))
