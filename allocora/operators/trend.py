"""Per-group trends, projections and robust slopes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.functions import fixed
from allocora.functions.labels import direction, gap_status
from allocora.functions.numeric import count_where
from allocora.functions.tails import trend_p_value
from allocora.operators.slopes import median_slope


def trend_fit(df: DataFrame, by: Sequence[str], y: str, period: str = "period", origin: int = 2000) -> DataFrame:
    """Least-squares line of ``y`` on the period per group, with R² and two-sided p-value.

    Periods are counted from ``origin`` inside the sums, which keeps them well
    conditioned; slope and intercept are on the original scale. The p-value is
    NULL below three points and for a constant series.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(period).isNotNull())
    t = (F.col(period) - F.lit(origin)).cast("double")
    slope = F.regr_slope(F.col(y), t)
    fits = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.countDistinct(period).cast("int").alias("n_periods"),
        slope.alias("slope"),
        (F.regr_intercept(F.col(y), t) - slope * F.lit(float(origin))).alias("intercept"),
        F.when(F.min(y) != F.max(y), F.regr_r2(F.col(y), t)).alias("r2"),
    )
    return fits.withColumn("p", trend_p_value(F.col("r2"), F.col("n")))


def line_at(period: Column | int) -> Column:
    t = period if isinstance(period, Column) else F.lit(period)
    return F.col("intercept") + F.col("slope") * t


def enough_history(df: DataFrame, unit: str = "unit", period: str = "period", minimum: int = fixed.MIN_HISTORY) -> DataFrame:
    """Units with at least ``minimum`` distinct periods."""
    return df.groupBy(unit).agg(F.countDistinct(period).alias("n_periods")).filter(F.col("n_periods") >= minimum)


def project_log(fits: DataFrame, base: int, horizon: int, floor_at_zero: bool = False) -> DataFrame:
    """Base and horizon values of trends fitted on ln(1 + value), growth, significance, direction."""
    at_base, at_horizon = F.expm1(line_at(base)), F.expm1(line_at(horizon))
    if floor_at_zero:
        at_base, at_horizon = F.greatest(at_base, F.lit(0.0)), F.greatest(at_horizon, F.lit(0.0))
    annual = (F.exp("slope") - 1) * 100
    return fits.withColumns(
        {
            "fit_base": at_base,
            "fit_horizon": at_horizon,
            "annual_pct": annual,
            "pct_change": (F.try_divide(at_horizon, at_base) - 1) * 100,
            "trend_significant": F.coalesce(F.col("p") < fixed.SIGNIFICANCE, F.lit(False)),
            "direction": direction(annual),
        }
    )


def unit_projection(
    panel: DataFrame,
    units: DataFrame,
    attributes: Sequence[str],
    base: int,
    horizon: int,
    unit: str = "unit",
    period: str = "period",
    outcome: str = "outcome",
) -> DataFrame:
    """Projection of every scored unit with enough history.

    The outcome is taken from the whole panel, not the modelled rows. The trend is
    fitted before the attributes are joined, so only one row per unit is joined.
    """
    rows = (
        panel.select(unit, period, outcome)
        .filter(F.col(outcome).isNotNull())
        .withColumn("log1p_value", F.log1p(outcome))
    )
    fits = trend_fit(rows, [unit], "log1p_value", period, origin=base).filter(
        F.col("n_periods") >= fixed.MIN_HISTORY
    )
    return project_log(fits, base, horizon).join(units.select(unit, *attributes), unit, "inner")


def region_gap_trend(
    scored: DataFrame, base: int, horizon: int, region: str = "region", period: str = "period", score: str = "score"
) -> DataFrame:
    """Trend of the region's mean score per period, its value at base and horizon, and its status."""
    means = region_series(scored, region, period, score)
    fits = trend_fit(means, [region], "gap", period, origin=base)
    return fits.withColumns({"gap_base": line_at(base), "gap_horizon": line_at(horizon)}).withColumn(
        "status", gap_status("gap_base", "slope")
    )


def region_series(scored: DataFrame, region: str = "region", period: str = "period", score: str = "score") -> DataFrame:
    rows = scored.filter(F.col(region).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(region, period).agg(F.avg(score).alias("gap"))


def slope_without_last(df: DataFrame, by: Sequence[str], y: str, last: int, period: str = "period") -> DataFrame:
    """Slope over all periods and over those before ``last``, from one aggregate."""
    t = (F.col(period) - F.lit(last)).cast("double")
    before = F.when(F.col(period) < last, F.col(y))
    return df.groupBy(*by).agg(
        F.regr_slope(F.col(y), t).alias("slope"), F.regr_slope(before, t).alias("slope_without_last")
    )


def members_deepening(scored: DataFrame, region: str, unit: str, period: str, score: str) -> DataFrame:
    """Units per region with enough history, and how many of them have a falling score."""
    fits = trend_fit(scored.filter(F.col(region).isNotNull()), [region, unit], score, period)
    return (
        fits.filter(F.col("n_periods") >= fixed.MIN_HISTORY)
        .groupBy(region)
        .agg(F.count("*").alias("n_units"), count_where(F.col("slope") < 0).alias("n_deepening"))
    )


def theil_sen(series: DataFrame, by: Sequence[str], y: str, period: str = "period") -> DataFrame:
    """Median of the slopes between all periods of a group's series; NULL without two different periods.

    ``series`` has about one row per group and period, so a group's points fit one
    row. No pair becomes a row: pairs are counted as inversions, in time n log n and
    memory bounded by the block of :func:`median_slope`. Points of one period make no
    pair.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(period).cast("double").alias("t"), F.col(y).cast("double").alias("v"))))
    known = series.filter(F.col(y).isNotNull() & F.col(period).isNotNull())
    grouped = known.groupBy(*by).agg(points.alias("_points"))
    schema = T.StructType([*(grouped.schema[c] for c in by), T.StructField("theil_sen", T.DoubleType())])

    def slopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            medians = [
                median_slope(np.array([q["t"] for q in row]), np.array([q["v"] for q in row]))
                for row in batch["_points"]
            ]
            yield batch[list(by)].assign(theil_sen=pd.Series(medians, index=batch.index, dtype=object))

    return grouped.mapInPandas(slopes, schema)
