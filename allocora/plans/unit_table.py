"""Unit table: averages, tiers, ranks, thin flag and profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.functions.numeric import ratio
from allocora.operators.aggregates import recent_level
from allocora.operators.ranking import quartile_profile, tier_ranks
from allocora.runtime import stage

# Panel column → averaged column of the unit table.
AVERAGES = {
    "need": "need_mean",
    "outcome": "outcome_mean",
    "wealth": "wealth_mean",
    "gov": "gov_mean",
}


def unit_scores(
    scored: DataFrame,
    unit: str = "unit",
    period: str = "period",
    score: str = "score",
    tier: str = "tier",
    averages: Mapping[str, str] = AVERAGES,
    carried: tuple[str, ...] = ("unit_name", "region"),
) -> DataFrame:
    """One row per unit: period count, mean and spread of the known scores, averages, modal and recent tier.

    Counting per unit and tier first and combining those rows gives the modal tier
    and every average from one pass over the scored rows. Rows without a score
    count as periods only. Spreads are combined as count, mean and squared
    deviations, so that a large mean costs no digits.
    """
    sums = {**{f"_s_{c}": F.sum(c) for c in averages}, **{f"_c_{c}": F.count(c) for c in averages}}
    need, outcome = list(averages)[0], list(averages)[1]
    quotient = ratio(outcome, need)
    levels = scored.groupBy(unit, tier).agg(
        F.count("*").alias("_n"),
        F.max(period).alias("_last"),
        F.struct(
            F.count(score).cast("double").alias("n"),
            F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop(score) * F.count(score), F.lit(0.0)).alias("squares"),
        ).alias("_score"),
        F.sum(quotient).alias("_q"),
        F.count(quotient).alias("_qn"),
        *[F.first(c).alias(c) for c in carried],
        *[e.alias(n) for n, e in sums.items()],
    )
    n = F.sum("_n")
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    score_of = F.aggregate(F.collect_list("_score"), none, _combined)  # a unit has few tiers
    units = levels.groupBy(unit).agg(
        *[F.first(c).alias(c) for c in carried],
        n.cast("int").alias("n_periods"),
        score_of.alias("_score"),
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_c_{c}")).alias(name) for c, name in averages.items()],
        F.try_divide(F.sum("_q"), F.sum("_qn")).alias("ratio_mean"),
        F.max_by(tier, F.when(F.col(tier).isNotNull(), F.struct("_n", "_last"))).alias("tier"),
        recent_level(tier, "_last").alias("tier_recent"),
    )
    known, squares = F.col("_score.n"), F.col("_score.squares")
    figures = {
        "score_mean": F.when(known > 0, F.col("_score.mean")),
        "score_std": F.when(known > 1, F.sqrt(squares / (known - 1))),
    }
    after = units.columns.index("_score")
    return units.select(*units.columns[:after], *[c.alias(name) for name, c in figures.items()], *units.columns[after + 1 :])


def _combined(a: Column, b: Column) -> Column:
    """Count, mean and squared deviations of two sets together."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
    return F.struct(
        n.alias("n"),
        (a["mean"] + apart * share).alias("mean"),
        (a["squares"] + b["squares"] + apart * apart * a["n"] * share).alias("squares"),
    )


def unit_table(scored: DataFrame) -> DataFrame:
    """Unit scores with peer ranks, thin flag and profile, of a table bucketed by unit.

    The averages are staged first: ranks are joined back by value, so the sums
    behind them must not be computed twice.
    """
    base = stage(unit_scores(scored), "unit_scores", bucket_by="unit", partitioned=True)
    profiled = quartile_profile(base.withColumn("thin_data", F.col("n_periods") < fixed.THIN_PERIODS), "score_mean")
    return tier_ranks(profiled, "score_mean", "tier")
