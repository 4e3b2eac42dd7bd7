"""Ordered operators that stay exact and parallel when one key holds a large share of all rows.

A window partitioned by a key sorts that key's rows in one task. Every operator here first asks
one cheap question - has any key more than ``rows`` rows? - by a count that is combined map-side.
If not, it is the plain window. If so, the rows are written once to reliable storage, keys above
the limit are cut into value ranges of their numeric order column, windows run per (key, range),
and the few numbers that must cross a range border (row counts, sums, last seen values) travel
as one small row per range. ``split`` answers the question beforehand where the size is known.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

ROWS_PER_RANGE = 1_000_000

_RANGE, _HEAVY = "_range", "_heavy"


def is_hot(df: DataFrame, keys: Sequence[str], rows: int = ROWS_PER_RANGE) -> bool:
    """Whether any key has more than ``rows`` rows."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).isEmpty()


def with_ranges(df: DataFrame, keys: Sequence[str], order: str, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``_range`` (0 for ordinary keys) and ``_heavy`` to every row."""
    keys = list(keys)
    heavy = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))
        .where(F.col("_n") > rows)
        .select(*keys, "_lo", (F.col("_hi") - F.col("_lo")).alias("_span"), F.ceil(F.col("_n") / rows).alias("_parts"))
    )
    at = F.floor((F.col(order).cast("double") - F.col("_lo")) / F.col("_span") * F.col("_parts"))
    where = F.when(F.col("_span") > 0, F.least(at, F.col("_parts") - 1))
    return (
        df.join(heavy, keys, "left")
        .withColumn(_HEAVY, F.col("_parts").isNotNull())
        .withColumn(_RANGE, F.coalesce(where, F.lit(0)).cast("long"))
        .drop("_lo", "_span", "_parts")
    )


def _border(ranged: DataFrame, keys: list[str], per_range: list[Column], across: Mapping[str, Column]) -> DataFrame:
    """One row per (heavy key, range) with values carried over the range borders."""
    table = ranged.where(F.col(_HEAVY)).groupBy(*keys, _RANGE).agg(*per_range)
    return table.select(*keys, _RANGE, *[c.alias(n) for n, c in across.items()])


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _after(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(1, Window.unboundedFollowing)


def ranked(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), name: str = "rn",
           rows: int = ROWS_PER_RANGE, split: bool | None = None) -> DataFrame:
    """Exact ``row_number`` per key, counted from 1."""
    keys = list(keys)
    if not (is_hot(df, keys, rows) if split is None else split):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)).cast("long"))
    ranged = with_ranges(cut(df), keys, order, rows)
    border = _border(ranged, keys, [F.count(F.lit(1)).alias("_c")], {"_skip": F.sum("_c").over(_before(keys))})
    inside = F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(order, *ties))
    return (
        ranged.withColumn(name, inside.cast("long"))
        .join(border, [*keys, _RANGE], "left")
        .withColumn(name, F.col(name) + F.coalesce("_skip", F.lit(0)))
        .drop("_skip", _RANGE, _HEAVY)
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str,
                rows: int = ROWS_PER_RANGE, split: bool | None = None) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including this one."""
    keys = list(keys)
    upto = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if not (is_hot(df, keys, rows) if split is None else split):
        return df.withColumn(name, F.sum(value).over(upto(*keys)))
    ranged = with_ranges(cut(df), keys, order, rows)
    border = _border(ranged, keys, [F.sum(value).alias("_s")], {"_skip": F.sum("_s").over(_before(keys))})
    return (
        ranged.withColumn(name, F.sum(value).over(upto(*keys, _RANGE)))
        .join(border, [*keys, _RANGE], "left")
        .withColumn(name, F.col(name) + F.coalesce("_skip", F.lit(0)))
        .drop("_skip", _RANGE, _HEAVY)
    )


def carried(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], columns: Mapping[str, str],
            rows: int = ROWS_PER_RANGE, split: bool | None = None) -> DataFrame:
    """For each ``new: source`` the last non-NULL source at or before the row, else the first after it.

    This is the sorted look-up behind every as-of and segment join of the library.
    """
    keys = list(keys)

    def looked_up(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order, *ties)
        # What comes after is asked for only where nothing came before: there the first of all rows is the answer, and no row looks at those behind it.
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return frame.withColumns({f"_b_{new}": F.last(src, ignorenulls=True).over(back) for new, src in columns.items()} |
                                 {f"_a_{new}": F.first(src, ignorenulls=True).over(ahead) for new, src in columns.items()})

    if not (is_hot(df, keys, rows) if split is None else split):
        out = looked_up(df, keys).withColumns({new: F.coalesce(f"_b_{new}", f"_a_{new}") for new in columns})
        return out.drop(*[f"_{p}_{new}" for new in columns for p in "ba"])
    ranged = with_ranges(cut(df), keys, order, rows)
    sort = F.struct(order, *ties)
    aggs, across = [], {}
    for new, src in columns.items():
        held = F.when(F.col(src).isNotNull(), sort)
        aggs += [F.max_by(src, held).alias(f"_l_{new}"), F.min_by(src, held).alias(f"_f_{new}")]
        across[f"_p_{new}"] = F.last(f"_l_{new}", ignorenulls=True).over(_before(keys))
        across[f"_q_{new}"] = F.first(f"_f_{new}", ignorenulls=True).over(_after(keys))
    border = _border(ranged, keys, aggs, across)
    out = looked_up(ranged, [*keys, _RANGE]).join(border, [*keys, _RANGE], "left")
    out = out.withColumns({
        new: F.coalesce(f"_b_{new}", f"_p_{new}", f"_a_{new}", f"_q_{new}") for new in columns
    })
    extra = [f"_{p}_{new}" for new in columns for p in "bapq"]
    return out.drop(*extra, _RANGE, _HEAVY)


def with_halo(df: DataFrame, keys: Sequence[str], order: str, halo: int, rows: int = ROWS_PER_RANGE,
              split: bool | None = None) -> DataFrame:
    """Cut keys with many rows into blocks of ``rows`` rows, with ``halo`` rows repeated on both sides.

    Windows over ``halo_window(keys)`` that look at most ``halo`` rows away are then exact for the
    rows with ``_own``; ``drop_halo`` removes the others. Without a hot key there is one block.
    """
    keys = list(keys)
    if not (is_hot(df, keys, rows) if split is None else split):
        return df.withColumns({"_rn": F.col(order), "_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    r = cut(ranked(df, keys, order, name="_rn", rows=rows, split=True))
    block = F.floor((F.col("_rn") - 1) / rows)
    pos = F.pmod(F.col("_rn") - 1, F.lit(rows))
    homes = F.array_compact(F.array(
        block, F.when((pos < halo) & (block > 0), block - 1), F.when(pos >= rows - halo, block + 1)))
    return r.withColumn("_home", block).withColumn("_block", F.explode(homes)).withColumn(
        "_own", F.col("_block") == F.col("_home")).drop("_home")


def halo_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "_block").orderBy("_rn")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block", "_rn")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting that ``df`` has at most ``max_rows`` rows.

    Beyond that the table is joined by key like any other; the adaptive planner then splits hot keys.
    """
    counted = df.select(F.lit(1)).limit(max_rows + 1).count()
    return F.broadcast(df) if counted <= max_rows else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Distribute a small table by key before its rows are expanded.

    The number of partitions is explicit, so the adaptive planner does not merge them again on
    account of the small input.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
