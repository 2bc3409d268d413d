"""Within transform for one fixed effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.runtime import small_table


def demean(df: DataFrame, columns: Sequence[str], effect: str) -> DataFrame:
    """Subtract the mean of each effect level.

    Levels are few and large, so their means come from a combined aggregate and
    are joined back by checked broadcast; a window would put a level in one task.
    """
    means = df.groupBy(effect).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = df.join(small_table(means), effect)
    return joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
