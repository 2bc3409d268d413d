"""Gini, Lorenz curve, concentration figures and shares of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.functions.numeric import ratio
from allocora.operators.ordered import order_by_value

POINTS_PER_BLOCK = 1000


def _ordered_mass(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    kept = df.filter(F.col(value) >= 0)
    return order_by_value(kept, value, by, sums={"mass": F.sum(value)})


def gini(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient of the non-negative values, NULL where they sum to zero."""
    ordered = _ordered_mass(df, value, by)
    c, b = F.col("ties").cast("double"), F.col("before").cast("double")
    weighted = F.sum(F.col(value) * (c * b + c * (c + 1) / 2))
    n = F.max("total")
    mass = F.max("mass_total")
    return ordered.groupBy(*by).agg(
        n.alias("n"), (ratio(2 * weighted, n * mass) - (n + 1) / n).alias("gini")
    )


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """Cumulative share of units and value, one point per unit after the origin.

    Tied units are first emitted as blocks, spread over the tasks, then as points.
    """
    table = _ordered_mass(df, value)
    blocks = table.select(
        value, "ties", "before", "total", "mass_before", "mass_total",
        F.explode(F.sequence(F.lit(0), (F.col("ties") - 1).cast("long"), F.lit(POINTS_PER_BLOCK).cast("long"))).alias("start"),
    ).repartition(value, "start")
    inside = F.sequence(
        F.col("start") + 1, F.least(F.col("start") + POINTS_PER_BLOCK, F.col("ties").cast("long"))
    )
    points = blocks.select("*", F.explode(inside).alias("i")).select(
        (F.col("before") + F.col("i")).cast("bigint").alias("point"),
        ((F.col("before") + F.col("i")) / F.col("total")).alias("cum_units"),
        ratio(F.col("mass_before") + F.col("i") * F.col(value), F.col("mass_total")).alias("cum_value"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("cum_units"), F.lit(0.0).alias("cum_value")
    )
    return origin.unionByName(points)


def concentration_facts(df: DataFrame, value: str, top: int = fixed.CONCENTRATION_TOP) -> DataFrame:
    """One row: where the curve reaches half, and the shares of the bottom half and the top."""
    table = _ordered_mass(df, value)
    v, b, c = F.col(value), F.col("before"), F.col("ties")
    n, mass = F.col("total"), F.col("mass_total")

    def mass_at(position):
        inside = (b < position) & (position <= b + c)
        return F.max(F.when(inside, F.col("mass_before") + (position - b) * v))

    reaches = (v > 0) & (F.col("mass_before") + F.col("mass") >= 0.5 * mass)
    steps = F.greatest(F.ceil(ratio(0.5 * mass - F.col("mass_before"), v)), F.lit(1))
    half = F.min(F.when(reaches, b + steps))
    facts = table.agg(
        F.max("total").alias("n"),
        F.max("mass_total").alias("mass"),
        half.alias("half_index"),
        F.coalesce(mass_at(F.bround(n / 2, 0)), F.lit(0.0)).alias("_bottom"),
        F.coalesce(mass_at(n - top), F.lit(0.0)).alias("_rest"),
    )
    return facts.select(
        "n",
        F.col("half_index").cast("bigint").alias("half_index"),
        (F.col("half_index") / F.col("n")).alias("half_x"),
        ((F.col("n") - F.col("half_index")) / F.col("n")).alias("top_half_share"),
        ratio("_bottom", "mass").alias("bottom_half_share"),
        (1 - ratio("_rest", "mass")).alias("top_share"),
    )


def top_k_shares(df: DataFrame, value: str, unit: str, ks: Sequence[int] = fixed.TOP_KS) -> DataFrame:
    """Share of the total held by the k largest units, for each k."""
    from pyspark.sql import Window

    total = df.agg(F.sum(value)).scalar()
    leaders = df.orderBy(F.col(value).desc(), unit).limit(max(ks)).select(unit, value)
    # At most max(ks) rows are left here.
    ranked = leaders.withColumn("_rn", F.row_number().over(Window.orderBy(F.col(value).desc(), unit)))
    held = ranked.agg(*[F.sum(F.when(F.col("_rn") <= k, F.col(value))).alias(str(k)) for k in ks])
    return held.unpivot([], [F.col(f"`{k}`") for k in ks], "k", "held").select(
        F.col("k").cast("int").alias("k"), (F.col("held") / total).alias("share")
    )
