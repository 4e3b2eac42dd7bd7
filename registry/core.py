"""Registration of queries and the stand-in tables they read.

A stand-in gives the driver's tables thermal shape. Its SELECT is written once, with ``{table}``
placeholders, in the common subset of Spark SQL and DuckDB; the operators themselves are written
twice, with the library here and as SQL in the twin.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def names(text: str) -> set[str]:
    return {n for _, n, _, _ in Formatter().parse(text) if n}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str, text: str) -> DataFrame:
    """The stand-in as a DataFrame."""
    return spark.sql(text, **{n: table(spark, d, n) for n in names(text)})


def sub(text: str) -> str:
    """The stand-in as SQL text over the plain table names."""
    return text.format(**{n: n for n in names(text)})


# Both engines add the same tiny shift before rounding, so decimal ties fall on one side.
def _shift(n: int) -> float:
    return 1.3 * 10.0 ** -(n + 2)


def rnd(c: Column | str, n: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + _shift(n), n)


def R(expr: str, n: int = 6) -> str:
    """Rounded SQL expression without negative zero."""
    return f"(round(({expr}) + {_shift(n)!r}, {n}) + 0.0)"
