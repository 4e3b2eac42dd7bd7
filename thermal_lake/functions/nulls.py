"""Missing-value contract: non-finite numbers and empty text are NULL inside the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL for NaN and the infinities, the value otherwise."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def text(c: Column | str) -> Column:
    """NULL for empty text."""
    return F.nullif(col(c), F.lit(""))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with NULL for "no match"."""
    return text(F.regexp_extract(col(c), pattern, group))


def same(a: Column, b: Column) -> Column:
    """Content equality in which two missing values agree."""
    return a.eqNullSafe(b)


def enforce(df: DataFrame) -> DataFrame:
    """Apply the contract to every float, double and string column of a source."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(finite(f.name).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(text(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def finite_points(df: DataFrame, value: str = "t_c") -> DataFrame:
    """keep rows whose three coordinates and value are finite."""
    for name in ("x", "y", "z", value):
        df = df.where(finite(name).isNotNull())
    return df
