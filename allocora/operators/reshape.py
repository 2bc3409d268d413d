"""Wide to long, column choice and cleaning."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allocora.functions import numeric
from allocora.functions.text import as_column


_YEAR_HEADER = re.compile(r"(?P<year>[0-9]{4})(?:\s+\[YR[0-9]{4}\])?")


def header_year(header: str) -> int | None:
    """The year that a header such as ``2010`` or ``2010 [YR2010]`` stands for."""
    found = _YEAR_HEADER.fullmatch(header.strip())
    return int(found["year"]) if found else None


def plain_year_headers(df: DataFrame) -> DataFrame:
    """Name the columns of years by the year alone."""
    years = {c: header_year(c) for c in df.columns}
    return df.withColumnsRenamed({c: str(year) for c, year in years.items() if year is not None})


def drop_columns_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not re.search(pattern, c)])


def year_columns(columns: Iterable[str], first: int, last: int) -> list[str]:
    """Columns of the years from ``first`` to ``last``."""
    wanted = range(first, last + 1)
    return [c for c in columns if header_year(c) in wanted]


def unpivot_years(
    df: DataFrame, ids: Sequence[str], first: int, last: int, value: str, period: str = "period"
) -> DataFrame:
    """One row per id and year column in range; missing cells stay as NULL rows."""
    years = year_columns(df.columns, first, last)
    long = df.unpivot(list(ids), [F.col(f"`{y}`") for y in years], period, value)
    return long.withColumn(period, F.col(period).cast("int"))


def sentinel_to_null(c: Column | str, sentinel: str = "..") -> Column:
    return F.nullif(as_column(c), F.lit(sentinel))


def clean_number(c: Column | str) -> Column:
    return numeric.to_number(c)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listwise deletion."""
    return df.na.drop(subset=list(columns))


def exclude_key(df: DataFrame, column: str, key: object) -> DataFrame:
    """Drop the rows of one key; rows without a key stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(key)))


def replace_where(df: DataFrame, column: str, condition: Column, value: object) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def dummies(df: DataFrame, column: str, levels: Sequence[object], prefix: str | None = None) -> DataFrame:
    """0/1 column for every sorted level but the first."""
    rest = sorted(levels)[1:]
    name = prefix or column
    return df.withColumns(
        {f"{name}_{level}": F.coalesce(F.col(column) == F.lit(level), F.lit(False)).cast("int") for level in rest}
    )


def fill_within_unit(df: DataFrame, column: str, unit: str = "unit", period: str = "period") -> DataFrame:
    """Next known value of the unit, else its last known one; never another unit's."""
    from pyspark.sql import Window

    w = Window.partitionBy(unit).orderBy(period)
    following = F.first(column, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    preceding = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(column, F.coalesce(following, preceding))
