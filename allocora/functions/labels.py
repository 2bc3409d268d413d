"""Label expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.functions.text import as_column


def direction(annual_pct: Column | str, band: float = fixed.DIRECTION_PCT) -> Column:
    pct = as_column(annual_pct)
    up, down, level = fixed.DIRECTION_WORDS
    return F.when(pct > band, up).when(pct < -band, down).otherwise(level)


def gap_status(gap: Column | str, slope: Column | str) -> Column:
    """Whether a gap moves toward zero; looks at the direction now, not past a crossing."""
    move = as_column(gap) * as_column(slope)
    closing, widening, level = fixed.GAP_WORDS
    return F.when(move < 0, closing).when(move > 0, widening).otherwise(level)


def abs_gap_trend(slope: Column | str, n: Column | str, band: float = fixed.ABS_GAP_SLOPE) -> Column:
    s = as_column(slope)
    few, narrowing, widening, steady = fixed.ABS_GAP_WORDS
    return F.when(as_column(n) < 3, few).when(s < -band, narrowing).when(s > band, widening).otherwise(steady)


def stars(p: Column | str) -> Column:
    p = as_column(p)
    chain = None
    for limit, mark in fixed.STARS:
        chain = F.when(p < limit, mark) if chain is None else chain.when(p < limit, mark)
    return chain.otherwise("")


def p_text(p: Column | str) -> Column:
    p = as_column(p)
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def ordered_levels(spark: SparkSession, levels: Sequence[str], name: str) -> DataFrame:
    """The given levels with their order, one row each."""
    rows = [(level, i) for i, level in enumerate(levels, 1)]
    return spark.createDataFrame(rows, f"{name} string, {name}_order int")
