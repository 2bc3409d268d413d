"""Report tables, for all units at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allocora.functions import fixed, text
from allocora.functions.labels import abs_gap_trend
from allocora.functions.numeric import count_where, ratio, share
from allocora.operators.concentration import gini, top_k_shares
from allocora.operators.quantiles import column_quantiles
from allocora.operators.ranking import extremes, relative_position
from allocora.operators.sets import keys_missing_from
from allocora.operators.trend import line_at, region_series
from allocora.runtime import small_table


@dataclass(frozen=True)
class Wording:
    """Nouns of the text reports."""

    unit: str = "Country"
    outcome: str = "adaptation aid"
    need: str = "vulnerability"


def label_points(units: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """Short name and position of the n lowest units that are not thin and have a position."""
    lowest = extremes(units.filter(~F.col("thin_data")), "score_mean", n)
    # At most n rows, so the side that is broadcast is bounded by construction.
    return points.join(F.broadcast(lowest), "unit").select("unit", text.short_name("unit_name").alias("short"), "lat", "lon")


def region_gap(units: DataFrame, score: str = "score_mean", region: str = "region") -> DataFrame:
    """Region size, mean and share below zero next to each unit, and the unit's distance to the mean."""
    regions = units.groupBy(region).agg(
        F.count("*").alias("region_n"), F.avg(score).alias("region_mean"), share(F.col(score) < 0).alias("region_share_below")
    )
    return units.join(small_table(regions), region, "left").withColumn("gap", F.col(score) - F.col("region_mean"))


def headline_kpis(units: DataFrame, top: int = fixed.CONCENTRATION_TOP) -> DataFrame:
    """Units scored, concentration, share of the top units, and the regions below zero."""
    regions = units.filter(F.col("region").isNotNull()).groupBy("region").agg(F.avg("score_mean").alias("m"))
    below = F.struct(F.col("m"), F.col("region"))
    listed = F.array_sort(F.collect_list(F.when(F.col("m") < 0, below)))
    line = F.transform(listed, lambda r: F.concat(r["region"], F.lit(" ("), text.fixed(r["m"], signed=True), F.lit(")")))
    region_row = regions.agg(
        count_where(F.col("m") < 0).alias("n_regions_below"), F.count("*").alias("n_regions"), F.array_join(line, ", ").alias("regions_below")
    )
    return region_row.select(
        units.agg(F.count("*")).scalar().alias("n_units"),
        gini(units, "outcome_mean").select("gini").scalar().alias("gini"),
        top_k_shares(units, "outcome_mean", "unit", [top]).select("share").scalar().alias("top_share"),
        "n_regions_below",
        "n_regions",
        "regions_below",
    )


def thin_headline_units(units: DataFrame) -> DataFrame:
    """Thin units in the headline tiers, whose rank needs the caveat."""
    return units.filter(F.col("tier").isin(*fixed.HEADLINE_TIERS) & F.col("thin_data"))


def map_rows(units: DataFrame) -> DataFrame:
    marker = F.when(F.col("thin_data"), fixed.MAP_MARKER).otherwise("")
    return relative_position(units, "score_mean").withColumn("marker", marker)


def map_scale(units: DataFrame) -> DataFrame:
    """Whole-number ticks of a scale that reaches equally far on both sides of zero."""
    reach = units.agg(F.max(F.abs("score_mean")).alias("reach")).withColumn("top", F.floor("reach").cast("int"))
    tick = F.col("tick")
    words = fixed.SCALE_WORDS
    word = (
        F.when(tick == 0, words["zero"])
        .when(tick == -F.col("top"), words["lowest"])
        .when(tick == F.col("top"), words["highest"])
        .when(tick < 0, words["below"])
        .otherwise(words["above"])
    )
    number = F.when(tick == 0, "0").otherwise(F.format_string("%+d", tick))
    ticks = reach.select("reach", "top", F.explode(F.sequence(-F.col("top"), F.col("top"))).alias("tick"))
    return ticks.select("reach", "tick", F.concat(number, F.lit("  · "), word).alias("text"))


def unit_summary(units: DataFrame, words: Wording = Wording()) -> DataFrame:
    """Two sentences groups per unit: its own position, and its region's."""
    rows = region_gap(units)
    say = fixed.SUMMARY_SENTENCES
    score, name, region = F.col("score_mean"), F.col("unit_name"), F.col("region")
    extreme = (
        F.when(F.col("tier_rank") == 1, say["lowest"]).when(F.col("tier_rank") == F.col("tier_n"), say["highest"]).otherwise("")
    )
    own = F.concat_ws(
        " ",
        text.render(say["profile"], name=name, profile=F.col("profile")),
        text.render(
            say["rank"], outcome_word=words.outcome, distance=text.fixed(F.abs(score)),
            side=F.when(score < 0, "below").otherwise("above"), rank=text.ordinal("tier_rank"), rank_of=F.col("tier_n"),
            tier=text.map_labels("tier", fixed.TIER_INCOME_LABELS, F.col("tier")), extreme=extreme,
        ),
        text.render(say["need"], need_word=words.need, periods=F.col("n_periods"), need=text.fixed("need_mean")),
        F.when(F.col("thin_data"), say["thin"]),
    )
    known_share = F.when(
        F.col("region_n") >= fixed.REGION_SHARE_MIN_UNITS, text.render(say["share"], below=text.percent("region_share_below"))
    ).otherwise("")
    compared = F.concat(
        text.render(
            say["region"], region_n=F.col("region_n"), region=region, region_mean=text.fixed("region_mean", signed=True),
            region_side=F.when(F.col("region_mean") < 0, "under-allocated").otherwise("over-allocated"),
        ),
        known_share,
        text.render(
            say["gap"], name=name, gap=text.fixed(F.abs("gap")),
            relation=F.when(F.col("gap") < 0, "more underfunded than").otherwise("better funded than"),
        ),
    )
    place = F.when(F.col("region_n") == 1, text.render(say["alone"], name=name, region=region)).otherwise(compared)
    return rows.select("unit", own.alias("unit_text"), place.alias("region_text"))


def facts(units: DataFrame, regional: DataFrame, projection: DataFrame) -> DataFrame:
    """Unit, regional and projected figures in one row; figures without a match are NULL."""
    regions = regional.select("region", F.col("status").alias("region_status"), "gap_base", "gap_horizon")
    projected = projection.select("unit", "fit_horizon", "pct_change", "annual_pct", "trend_significant")
    return units.join(small_table(regions), "region", "left").join(projected, "unit", "left")


def facts_text(rows: DataFrame, first: int, base: int, horizon: int, words: Wording = Wording()) -> DataFrame:
    """The facts block of every unit; lines without figures are left out."""
    line = fixed.FACT_LINES
    region = F.col("region")
    significance = F.when(F.col("trend_significant"), "statistically significant").otherwise("not statistically significant")
    lines: list[Column] = [
        text.render(line["unit"], unit_word=words.unit, name=F.col("unit_name"), region=region),
        text.render(line["profile"], profile=F.col("profile")),
        text.render(line["score"], score=text.fixed("score_mean", signed=True), outcome_word=words.outcome),
        text.render(line["rank"], tier=F.col("tier"), rank=F.col("tier_rank"), rank_of=F.col("tier_n")),
        text.render(line["need"], need_word=words.need, need=text.fixed("need_mean")),
        text.render(line["outcome"], outcome_word=words.outcome, outcome=text.fixed("outcome_mean"), periods=F.col("n_periods")),
        F.when(F.col("thin_data"), line["thin"]),
        text.render(
            line["region"], region=region, status=F.col("region_status"), gap_base=text.fixed("gap_base", signed=True),
            gap_horizon=text.fixed("gap_horizon", signed=True), base=base, horizon=horizon,
        ),
        text.render(
            line["projection"], first=first, base=base, horizon=horizon, outcome_word=words.outcome,
            projected=text.fixed("fit_horizon", 0, grouped=True), change=text.fixed("pct_change", 0, signed=True),
            annual=text.fixed("annual_pct", 1, signed=True), significance=significance,
        ),
    ]
    return rows.select("unit", F.concat_ws("\n", *lines).alias("facts"))


def fit_by_tier(scored: DataFrame, actual: str = "log_outcome", predicted: str = "predicted") -> DataFrame:
    """Size, correlation, share of large misses and the widest shortfall, overall and per tier."""
    miss = F.abs("score") > 1
    widest = F.min_by(F.struct("unit_name", "period", "score"), F.struct("score", "unit", "period"))
    figures = [
        F.count("*").alias("n"),
        F.when(F.count("*") > 2, F.corr(predicted, actual)).alias("r"),
        share(miss).alias("share_large"),
        widest.alias("_w"),
    ]
    per_tier = scored.groupBy("tier").agg(*figures)
    overall = scored.agg(*figures).select(F.lit("All").alias("tier"), "*")
    return overall.unionByName(per_tier).select(
        "tier", "n", "r", "share_large", F.col("_w.unit_name").alias("widest_unit"),
        F.col("_w.period").alias("widest_period"), F.col("_w.score").alias("widest_score"),
    )


def trajectory(scored: DataFrame) -> DataFrame:
    """Score path per unit, with its side of zero and, from three periods on, the unit's mean."""
    w = Window.partitionBy("unit")
    return scored.select(
        "unit", "period", "predicted", "log_outcome", "score",
        F.when(F.count("*").over(w) >= 3, F.avg("score").over(w)).alias("unit_mean"),
        F.when(F.col("score") < 0, "below").otherwise("above").alias("side"),
    )


def trajectory_stats(scored: DataFrame, origin: int = 2000) -> DataFrame:
    """Headline, periods below zero, mean and trend of the absolute score, per unit."""
    t = (F.col("period") - origin).cast("double")
    stats = scored.groupBy("unit").agg(
        F.first("unit_name").alias("unit_name"),
        F.count("*").alias("n"),
        count_where(F.col("score") < 0).alias("n_below"),
        F.avg("score").alias("mean_score"),
        F.regr_slope(F.abs("score"), t).alias("abs_slope"),
    )
    say = fixed.TRAJECTORY_HEADLINES
    headline = (
        F.when(F.col("mean_score") < -fixed.HEADLINE_MEAN, text.render(say["low"], name=F.col("unit_name")))
        .when(F.col("mean_score") > fixed.HEADLINE_MEAN, text.render(say["high"], name=F.col("unit_name")))
        .otherwise(text.render(say["middle"], name=F.col("unit_name")))
    )
    return stats.withColumns({"headline": headline, "trend": abs_gap_trend("abs_slope", "n")})


def regional_cards(regional: DataFrame) -> DataFrame:
    """Closing and widening regions, and the leading needy region of either kind."""
    needy = F.col("gap_base") < 0
    row = F.struct(F.col("region"), (F.abs("gap_horizon") - F.abs("gap_base")).alias("change"))

    def lead(status: str) -> Column:
        return F.min_by(row, F.when(needy & (F.col("status") == status), F.struct("slope", "region")))

    return regional.agg(
        F.count("*").alias("n_regions"),
        count_where(F.col("status") == "widening").alias("n_widening"),
        count_where(F.col("status") == "closing").alias("n_closing"),
        lead("closing").alias("_c"),
        lead("widening").alias("_w"),
    ).select(
        "n_regions", "n_widening", "n_closing", (F.col("n_widening") - F.col("n_closing")).alias("balance"),
        F.col("_c.region").alias("closing_region"), F.col("_c.change").alias("closing_change"),
        F.col("_w.region").alias("widening_region"), F.col("_w.change").alias("widening_change"),
    )


def exclusions(panel: DataFrame, scored_units: DataFrame, inputs: Mapping[str, str]) -> DataFrame:
    """Units left unscored: the inputs they never have, their periods and their total."""
    left_out = panel.join(keys_missing_from(panel, scored_units, "unit"), "unit", "left_semi")
    figures = left_out.groupBy("unit", "unit_name").agg(
        *[F.every(F.col(c).isNull()).alias(f"_{c}") for c in inputs],
        F.min("period").alias("first"),
        F.max("period").alias("last"),
        F.sum("outcome").alias("total"),
    )
    return figures.select(
        "unit",
        "unit_name",
        F.concat_ws("; ", *[F.when(F.col(f"_{c}"), label) for c, label in inputs.items()]).alias("missing_inputs"),
        F.format_string("%d to %d", "first", "last").alias("periods"),
        "total",
        F.concat(F.lit("$"), text.fixed("total", 0, grouped=True), F.lit("M")).alias("total_text"),
    )


# What a projection means, by where the unit stands and where its outcome goes.
MEANINGS = {
    ("under", "Rising"): "{name} starts {profile}; its {outcome_word} rises, but rising with everyone else does not close the gap.",
    ("under", "Falling"): "{name} is {profile} and its {outcome_word} is falling, so the shortfall grows.",
    ("under", "Flat"): "{name} is {profile} and its {outcome_word} stays level, so the shortfall remains.",
    ("over", "Rising"): "{name} is {profile} and its {outcome_word} still rises, so the lead grows.",
    ("over", "Falling"): "{name} is {profile} and its {outcome_word} is falling, back toward need.",
    ("over", "Flat"): "{name} is {profile} and its {outcome_word} stays level, so the lead remains.",
    ("near", "Rising"): "{name} tracks need; a rising path keeps it near the model line.",
    ("near", "Falling"): "{name} tracks need; a falling path keeps it near the model line for now.",
    ("near", "Flat"): "{name} tracks need; a flat path keeps it near the model line.",
}
CAVEAT = " The trend is not statistically significant ({periods} observed periods): an illustration, not a forecast."


def meanings(projection: DataFrame, words: Wording = Wording()) -> DataFrame:
    """What each unit's projection means, and a caveat where the trend is not significant."""
    standing = (
        F.when(F.col("profile").isin(*fixed.PROFILES[:2]), "under").when(F.col("profile") == fixed.PROFILES[3], "over").otherwise("near")
    )
    body = None
    for (group, way), template in MEANINGS.items():
        here = (F.col("_standing") == group) & (F.col("direction") == way)
        said = text.render(template, name=F.col("unit_name"), profile=F.lower("profile"), outcome_word=words.outcome)
        body = F.when(here, said) if body is None else body.when(here, said)
    caveat = F.when(F.col("trend_significant"), "").otherwise(text.render(CAVEAT, periods=F.col("n_periods")))
    return projection.withColumn("_standing", standing).select("unit", F.concat(body, caveat).alias("meaning"))


def coverage(panel: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows with and without a score, and units with at least one."""
    flags = scored.select("unit", "period", F.lit(1).alias("_scored"))
    return panel.select("unit", "period").join(flags, ["unit", "period"], "left").agg(
        F.count("*").alias("n_rows"),
        F.count("_scored").alias("n_scored"),
        (F.count("*") - F.count("_scored")).alias("n_unscored"),
        F.countDistinct(F.when(F.col("_scored").isNotNull(), F.col("unit"))).alias("n_units_scored"),
    )


def region_lines(scored: DataFrame, regional: DataFrame, first: int, horizon: int) -> DataFrame:
    """Observed mean and fitted line per region and period up to the horizon."""
    grid = regional.select(
        "region", "slope", "intercept", "gap_horizon", F.explode(F.sequence(F.lit(first), F.lit(horizon))).alias("period")
    )
    return grid.join(region_series(scored), ["region", "period"], "left").select(
        "region", "period", F.col("gap").alias("observed"), line_at(F.col("period")).alias("fitted"), "gap_horizon"
    )


def fit_rows(scored: DataFrame, tiers: Sequence[str] | None = None) -> DataFrame:
    """Actual and predicted per row with the tier's label, optionally of some tiers only."""
    rows = scored.filter(F.col("tier").isin(list(tiers))) if tiers else scored
    return rows.select("unit", "period", text.map_labels("tier", fixed.TIER_LABELS).alias("tier_label"), "predicted", "log_outcome", "score")


def forecast_curve(panel: DataFrame, projection: DataFrame, first: int, base: int, horizon: int) -> DataFrame:
    """Fitted and projected outcome per unit and period next to what was observed."""
    grid = projection.select("unit", "slope", "intercept", F.explode(F.sequence(F.lit(first), F.lit(horizon))).alias("period"))
    part = F.when(F.col("period") <= base, "fitted").otherwise("projected")
    return grid.join(panel.select("unit", "period", "outcome"), ["unit", "period"], "left").select(
        "unit", "period", F.expm1(line_at(F.col("period"))).alias("curve"), F.col("outcome").alias("observed"), part.alias("part")
    )


def growth_by_profile(projection: DataFrame) -> DataFrame:
    """Median, mean and count of growth per profile, over all and over significant trends; no profile is a group too."""
    growth = projection.select("profile", "annual_pct", F.explode(
        F.when(F.col("trend_significant"), F.array(F.lit("all"), F.lit("significant"))).otherwise(F.array(F.lit("all")))
    ).alias("trends"))
    keys = ["trends", "profile"]
    medians, means = column_quantiles(
        growth, ["annual_pct"], {"median": 0.5}, keys, [F.avg("annual_pct").alias("mean"), F.count("*").alias("n")]
    )
    medians = medians.select(F.col("trends").alias("_trends"), F.col("profile").alias("_profile"), "median")
    same = (F.col("trends") == F.col("_trends")) & F.col("profile").eqNullSafe(F.col("_profile"))
    return means.join(medians, same, "left").drop("_trends", "_profile")


def growth_verdict(growth: DataFrame) -> DataFrame:
    """Whether the lowest profile grows at least as fast as the highest, over all trends."""
    def median_of(profile: str) -> Column:
        return F.max(F.when((F.col("trends") == "all") & (F.col("profile") == profile), F.col("median")))

    medians = growth.agg(median_of(fixed.PROFILES[0]).alias("lowest"), median_of(fixed.PROFILES[3]).alias("highest"))
    return medians.withColumn("verdict", F.when(F.col("lowest") >= F.col("highest"), "CLOSING").otherwise("ENTRENCHING"))
