"""Numeric expressions with NULL as the only missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.functions.text import as_column


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(as_column(a), as_column(b))


def to_number(c: Column | str) -> Column:
    """Number in a text cell, NULL where there is none."""
    return as_column(c).try_cast("double")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(as_column(c).cast("double"), digits) + F.lit(0.0)


def skewness_corrected(c: Column | str) -> Column:
    """Bias-corrected sample skewness, NULL below three values."""
    x = as_column(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def share(condition: Column) -> Column:
    """Share of rows satisfying a condition; a NULL comparison counts as not satisfied."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))
