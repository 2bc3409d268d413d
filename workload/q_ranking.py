"""Windows, ranks, profiles and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.operators import ranking
from allocora.operators.aggregates import extreme_row
from allocora.operators.ordered import exact_quantiles, min_rank, with_order
from allocora.operators.reshape import complete_cases, fill_within_unit
from allocora.plans.order_panel import INPUTS
from allocora.plans.reports import region_gap
from workload.registry import Stages, query, r6, rnd


@query("flagship_lowest_units", """
SELECT unit, unit_name, region, tier, n_periods, round(score_mean, 6) AS score_mean, tier_rank, tier_n, tier_pct, profile
FROM units ORDER BY units.score_mean, unit LIMIT 20""", uses="units")
def flagship_lowest_units(s: Stages) -> DataFrame:
    return ranking.extremes(s.units, "score_mean", 20).select(
        "unit", "unit_name", "region", "tier", "n_periods", *r6("score_mean"), "tier_rank", "tier_n", "tier_pct", "profile"
    )


@query("win_tier_rank", "SELECT unit, tier, tier_rank FROM units", uses="units")
def win_tier_rank(s: Stages) -> DataFrame:
    plain = s.units.select("unit", "tier", "score_mean")
    return ranking.tier_ranks(plain, "score_mean", "tier").select("unit", "tier", "tier_rank")


@query("win_tier_pct", """
WITH t AS (SELECT unit, region, period, rank() OVER w AS r, count(*) OVER (PARTITION BY region, n_orders) AS ties, count(*) OVER (PARTITION BY region) AS n
  FROM panel WINDOW w AS (PARTITION BY region ORDER BY n_orders))
FINAL SELECT unit, region, period, CAST(r AS INTEGER) AS tier_rank, round((r + (ties - 1) / 2.0) / n, 3) AS tier_pct FROM t""")
def win_tier_pct(s: Stages) -> DataFrame:
    rows = s.panel.select("unit", "region", "period", "n_orders")
    return ranking.tier_ranks(rows, "n_orders", "region").select("unit", "region", "period", "tier_rank", "tier_pct")


@query("win_text_rank", """
SELECT unit, period, CASE WHEN tier IS NOT NULL THEN CAST(rank() OVER (PARTITION BY region, tier IS NULL ORDER BY tier) AS INTEGER) END AS tier_place,
       CAST(rank() OVER (PARTITION BY region ORDER BY CAST(unit AS VARCHAR)) AS INTEGER) AS code_place FROM panel""")
def win_text_rank(s: Stages) -> DataFrame:
    rows = s.panel.select("unit", "period", "region", "tier", F.col("unit").cast("string").alias("code"))
    placed = with_order(rows, "tier", {"tier_place": min_rank()}, ["region"])
    return with_order(placed, "code", {"code_place": min_rank()}, ["region"]).select("unit", "period", "tier_place", "code_place")


@query("win_group_size", "SELECT unit, tier, tier_n FROM units", uses="units")
def win_group_size(s: Stages) -> DataFrame:
    return s.units.select("unit", "tier", "tier_n")


@query("win_bfill_ffill", "SELECT unit, period, tier FROM filled", uses="model")
def win_bfill_ffill(s: Stages) -> DataFrame:
    rows = complete_cases(s.panel, ["outcome", *INPUTS]).select("unit", "period", "tier")
    return fill_within_unit(rows, "tier")


@query("win_quartile_profile", "SELECT unit, profile FROM units", uses="units")
def win_quartile_profile(s: Stages) -> DataFrame:
    return ranking.quartile_profile(s.units.select("unit", "score_mean"), "score_mean").select("unit", "profile")


@query("win_quartile_edges", """
SELECT round(min(score_mean), 6) AS lowest, round(max(score_mean), 6) AS highest, round(quantile_cont(score_mean, 0.25), 6) AS q1,
       round(quantile_cont(score_mean, 0.5), 6) AS q2, round(quantile_cont(score_mean, 0.75), 6) AS q3 FROM units""", uses="units")
def win_quartile_edges(s: Stages) -> DataFrame:
    probs = {"lowest": 0.0, "highest": 1.0, "q1": 0.25, "q2": 0.5, "q3": 0.75}
    return exact_quantiles(s.units, "score_mean", probs).select(*r6(*probs))


POSITION_SQL = """
WITH pos AS (
  SELECT unit, score_mean, (rank() OVER (ORDER BY score_mean) - 1) * 1.0 / count(*) OVER () AS below,
         1 - cume_dist() OVER (ORDER BY score_mean) AS above FROM units)
FINAL SELECT unit, round(below, 6) AS below, round(above, 6) AS above,
  CASE WHEN score_mean < 0 THEN 'More underfunded than ' || printf('%.0f', round(above * 100, 8) + sign(above) * 1e-9) || '% of countries'
       WHEN score_mean > 0 THEN 'Better funded than ' || printf('%.0f', round(below * 100, 8) + sign(below) * 1e-9) || '% of countries'
       ELSE 'Right on the model line' END AS position
FROM pos"""


@query("win_relative_position", POSITION_SQL, uses="units")
def win_relative_position(s: Stages) -> DataFrame:
    placed = ranking.relative_position(s.units.select("unit", "score_mean"), "score_mean")
    return placed.select("unit", *r6("below", "above"), "position")


@query("win_region_gap", """
SELECT u.unit, u.region, r.n AS region_n, round(r.m, 6) AS region_mean, round(u.score_mean - r.m, 6) AS gap, round(r.s, 6) AS region_share_below
FROM units u JOIN (SELECT region, count(*) AS n, avg(score_mean) AS m, avg((score_mean < 0)::INT) AS s FROM units GROUP BY region) r ON r.region = u.region""", uses="units")
def win_region_gap(s: Stages) -> DataFrame:
    return region_gap(s.units).select("unit", "region", "region_n", *r6("region_mean", "gap", "region_share_below"))


@query("topk_per_tier", """
SELECT unit, tier, tier_rank, round(score_mean, 6) AS score_mean FROM units
QUALIFY row_number() OVER (PARTITION BY tier ORDER BY units.score_mean, unit) <= 15""", uses="units")
def topk_per_tier(s: Stages) -> DataFrame:
    return ranking.top_per_group(s.units, "tier", "score_mean", 15).select("unit", "tier", "tier_rank", *r6("score_mean"))


@query("topk_display_list", """
SELECT CAST(row_number() OVER (ORDER BY units.score_mean DESC, unit) AS INTEGER) AS place, unit, unit_name AS short,
       printf('%+.2f', round(score_mean, 8) + sign(score_mean) * 1e-9) AS score_text FROM units
QUALIFY row_number() OVER (ORDER BY units.score_mean DESC, unit) <= 5""", uses="units")
def topk_display_list(s: Stages) -> DataFrame:
    from allocora.functions import text

    top = ranking.extremes(s.units, "score_mean", 5, lowest=False)
    # Five rows: the window over them needs no partitions.
    place = F.row_number().over(Window.orderBy(F.col("score_mean").desc(), "unit"))
    return top.select(
        place.alias("place"), "unit", text.short_name("unit_name").alias("short"),
        text.fixed("score_mean", signed=True).alias("score_text"),
    )


@query("topk_rows_extremes", """
SELECT * FROM (SELECT 'lowest' AS side, unit, period, round(score, 6) AS score FROM scored ORDER BY scored.score, unit LIMIT 8) a
UNION ALL SELECT * FROM (SELECT 'highest' AS side, unit, period, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, unit LIMIT 8) b""", uses="scored")
def topk_rows_extremes(s: Stages) -> DataFrame:
    def side(label: str, lowest: bool) -> DataFrame:
        rows = ranking.extremes(s.scored, "score", 8, lowest=lowest)
        return rows.select(F.lit(label).alias("side"), "unit", "period", *r6("score"))

    return side("lowest", True).unionByName(side("highest", False))


@query("sort_multi_key", """
SELECT tier, unit, round(score_mean, 6) AS score_mean FROM units ORDER BY tier, units.score_mean, unit""", uses="units")
def sort_multi_key(s: Stages) -> DataFrame:
    return s.units.orderBy("tier", "score_mean", "unit").select("tier", "unit", *r6("score_mean"))


@query("topk_default_candidate", """
SELECT unit, unit_name, round(r2, 6) AS r2 FROM (
  SELECT *, coalesce(profile = 'Chronically Underfunded' AND trend_significant AND n_periods = 7, false) AS fit FROM projection) x
ORDER BY fit DESC, CASE WHEN fit THEN x.r2 END DESC NULLS LAST, CASE WHEN fit THEN unit END NULLS LAST, unit_name, unit LIMIT 1""", uses="projection")
def topk_default_candidate(s: Stages) -> DataFrame:
    fit = (F.col("profile") == fixed.PROFILES[0]) & F.col("trend_significant") & (F.col("n_periods") == 7)
    best = [F.col("r2").desc_nulls_last(), F.col("unit")]
    chosen = ranking.first_candidate(s.projection, fit, best, ["unit_name", "unit"])
    return chosen.select("unit", "unit_name", *r6("r2"))


@query("topk_default_trajectory", """
SELECT unit, n, round(m, 6) AS mean_score FROM (SELECT unit, count(*) AS n, avg(score) AS m FROM scored GROUP BY unit HAVING count(*) >= 5) x ORDER BY m, unit LIMIT 1""", uses="scored")
def topk_default_trajectory(s: Stages) -> DataFrame:
    means = s.scored.groupBy("unit").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).filter("n >= 5")
    return extreme_row(means, "mean_score", ["unit", "n", "mean_score"], "unit").select("unit", "n", *r6("mean_score"))
