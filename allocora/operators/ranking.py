"""Peer ranks, quartile profiles, positions and top-k lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.functions.text import percent
from allocora.operators.ordered import average_rank, exact_quantiles, min_rank, with_order


def tier_ranks(units: DataFrame, score: str, tier: str) -> DataFrame:
    """Rank (lowest score first), size and average-rank share within the tier.

    Tiers are few and large, so ranks come from ranges of the score within the
    tier and not from a window over it. Units without a tier have no rank.
    """
    columns = {
        "tier_rank": min_rank(),
        "tier_n": F.col("total").cast("int"),
        "tier_pct": F.round(average_rank() / F.col("total"), 3),
    }
    ranked = with_order(units.filter(F.col(tier).isNotNull()), score, columns, [tier])
    return ranked.unionByName(units.filter(F.col(tier).isNull()), allowMissingColumns=True)


def quartile_edges(units: DataFrame, score: str):
    """The inner quartile edges as one row on the driver."""
    return exact_quantiles(units, score, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()


def quartile_profile(units: DataFrame, score: str, labels: Sequence[str] = fixed.PROFILES, name: str = "profile") -> DataFrame:
    """Label by quartile of the score; edges belong to the lower quartile, ties stay together."""
    edges = quartile_edges(units, score)
    x = F.col(score)
    if edges["q1"] is None:
        return units.withColumn(name, F.lit(None).cast("string"))
    label = (
        F.when(x <= edges["q1"], labels[0])
        .when(x <= edges["q2"], labels[1])
        .when(x <= edges["q3"], labels[2])
        .when(x.isNotNull(), labels[3])
    )
    return units.withColumn(name, label)


def relative_position(units: DataFrame, score: str) -> DataFrame:
    """Share of units strictly below and above, and the sentence made of it."""
    n = F.col("total")
    shares = {"below": F.col("before") / n, "above": (n - F.col("before") - F.col("ties")) / n}
    placed = with_order(units, score, shares)
    return placed.withColumn("position", position_text(F.col(score), F.col("below"), F.col("above")))


def _between(words: tuple[str, str], text: Column) -> Column:
    return F.concat(F.lit(words[0]), text, F.lit(words[1]))


def position_text(score: Column, below: Column, above: Column) -> Column:
    return (
        F.when(score < 0, _between(fixed.POSITION_TEXTS["below"], percent(above)))
        .when(score > 0, _between(fixed.POSITION_TEXTS["above"], percent(below)))
        .when(score == 0, fixed.POSITION_TEXTS["on"])
    )


def extremes(df: DataFrame, score: str, n: int, unit: str = "unit", lowest: bool = True) -> DataFrame:
    """The n lowest or highest rows; ties go to the smaller unit."""
    order = F.col(score).asc() if lowest else F.col(score).desc()
    return df.filter(F.col(score).isNotNull()).orderBy(order, unit).limit(n)


def top_per_group(df: DataFrame, group: str, score: str, n: int, unit: str = "unit") -> DataFrame:
    """The n lowest rows of each group; each task keeps only n rows per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(score), F.col(unit))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_candidate(df: DataFrame, fit: Column, best: Sequence[Column], fallback: Sequence[str]) -> DataFrame:
    """The best row for which ``fit`` holds; if there is none, the first row in the order of ``fallback``.

    Either order keeps one row per task.
    """
    found = df.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    fits = found.filter("_fit").orderBy(*best).limit(1).withColumn("_turn", F.lit(0))
    others = found.orderBy(*fallback).limit(1).withColumn("_turn", F.lit(1))
    return fits.unionByName(others).orderBy("_turn").limit(1).drop("_fit", "_turn")
