"""Key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def keys_missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks."""
    return df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti")


def keys_in_both(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.select(key).intersect(other.select(key))


def stack(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with the same columns, matched by name."""
    return reduce(DataFrame.unionByName, frames)
