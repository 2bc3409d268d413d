"""Report tables and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.operators import quality
from allocora.plans import reports
from allocora.plans.order_panel import BASE_PERIOD, HORIZON, INPUTS
from workload.registry import Stages, query, r6, rnd
from workload.sql import signed2, text2

WORDS = reports.Wording()


def grouped0(x: str) -> str:
    return f"format('{{:,.0f}}', round({x}, 8) + sign({x}) * 1e-9)"


@query("report_kpis", """
WITH g AS (SELECT 2 * sum(rn * v) / (count(*) * sum(v)) - (count(*) + 1) * 1.0 / count(*) AS gini FROM (SELECT outcome_mean AS v, row_number() OVER (ORDER BY outcome_mean) AS rn FROM units) x),
t AS (SELECT sum(v) / (SELECT sum(outcome_mean) FROM units) AS s FROM (SELECT outcome_mean AS v FROM units ORDER BY v DESC LIMIT 15) x),
r AS (SELECT region, avg(score_mean) AS m FROM units GROUP BY region)
FINAL SELECT (SELECT count(*) FROM units) AS n_units, round(gini, 6) AS gini, round(s, 6) AS top_share, (SELECT count(*) FROM r WHERE m < 0) AS n_regions_below,
 (SELECT count(*) FROM r) AS n_regions, (SELECT coalesce(string_agg(region || ' (' || """ + signed2("m") + """ || ')', ', ' ORDER BY m), '') FROM r WHERE m < 0) AS regions_below FROM g, t""", uses="units")
def report_kpis(s: Stages) -> DataFrame:
    kpis = reports.headline_kpis(s.units)
    return kpis.select("n_units", *r6("gini", "top_share"), "n_regions_below", "n_regions", "regions_below")


@query("report_thin_data", """
SELECT tier, tier_rank, unit, unit_name, n_periods, round(score_mean, 6) AS score_mean FROM units WHERE thin_data AND tier IN ('L', 'LM')""", uses="units")
def report_thin_data(s: Stages) -> DataFrame:
    rows = reports.thin_headline_units(s.units)
    return rows.select("tier", "tier_rank", "unit", "unit_name", "n_periods", *r6("score_mean"))


@query("report_map_rows", f"""
WITH pos AS (SELECT *, (rank() OVER (ORDER BY score_mean) - 1) * 100.0 / count(*) OVER () AS below, (1 - cume_dist() OVER (ORDER BY score_mean)) * 100 AS above FROM units)
FINAL SELECT unit, round(score_mean, 6) AS score_mean, profile, tier, region, n_periods, CASE WHEN thin_data THEN 'thin data' ELSE '' END AS marker,
 CASE WHEN score_mean < 0 THEN 'More underfunded than ' || {text2('above', 0)} || '% of countries' WHEN score_mean > 0 THEN 'Better funded than ' || {text2('below', 0)} || '% of countries'
      ELSE 'Right on the model line' END AS position FROM pos""", uses="units")
def report_map_rows(s: Stages) -> DataFrame:
    rows = reports.map_rows(s.units)
    return rows.select("unit", *r6("score_mean"), "profile", "tier", "region", "n_periods", "marker", "position")


@query("report_map_scale", """
WITH m AS (SELECT max(abs(score_mean)) AS reach, CAST(floor(max(abs(score_mean))) AS INTEGER) AS top FROM units),
t AS (SELECT reach, top, CAST(unnest(range(-top, top + 1)) AS INTEGER) AS tick FROM m)
FINAL SELECT round(reach, 6) AS reach, tick, CASE WHEN tick = 0 THEN '0' ELSE printf('%+d', tick) END || '  · ' || CASE WHEN tick = 0 THEN 'as predicted'
 WHEN tick = -top THEN 'far below predicted' WHEN tick = top THEN 'far above predicted' WHEN tick < 0 THEN 'below predicted' ELSE 'above predicted' END AS text FROM t""", uses="units")
def report_map_scale(s: Stages) -> DataFrame:
    return reports.map_scale(s.units).select(*r6("reach"), "tick", "text")


@query("report_unit_summary", f"""
WITH r AS (SELECT region, count(*) AS n, avg(score_mean) AS m, avg((score_mean < 0)::INT) * 100 AS s FROM units GROUP BY region),
x AS (SELECT u.*, r.n AS rn, r.m AS rm, r.s AS rs, score_mean - r.m AS gap FROM units u JOIN r ON r.region = u.region)
FINAL SELECT unit, '**' || unit_name || '** is **' || profile || '**. Its adaptation aid sits ' || {text2('abs(score_mean)')} || ' log units ' ||
  CASE WHEN score_mean < 0 THEN 'below' ELSE 'above' END || ' the model''s prediction, ranking ' || tier_rank ||
  CASE WHEN tier_rank % 100 IN (11, 12, 13) THEN 'th' WHEN tier_rank % 10 = 1 THEN 'st' WHEN tier_rank % 10 = 2 THEN 'nd' WHEN tier_rank % 10 = 3 THEN 'rd' ELSE 'th' END ||
  ' of ' || tier_n || ' in the ' || CASE tier WHEN 'H' THEN 'high-income' WHEN 'UM' THEN 'upper-middle-income' WHEN 'LM' THEN 'lower-middle-income' ELSE 'low-income' END || ' tier' ||
  CASE WHEN tier_rank = 1 THEN ' (the most underfunded in its tier)' WHEN tier_rank = tier_n THEN ' (the most over-resourced in its tier)' ELSE '' END ||
  '. Average vulnerability over ' || n_periods || ' years is ' || {text2('need_mean')} || '.' || CASE WHEN thin_data THEN ' Based on only one or two years, so read with caution.' ELSE '' END AS unit_text,
  CASE WHEN rn = 1 THEN unit_name || ' is the only sampled country in **' || region || '**, so no regional comparison is available.'
  ELSE 'Across the ' || rn || ' sampled countries in **' || region || '**, the average misallocation is ' || {signed2('rm')} || ' (' || CASE WHEN rm < 0 THEN 'under-allocated' ELSE 'over-allocated' END ||
  ' overall).' || CASE WHEN rn >= 5 THEN ' ' || {text2('rs', 0)} || '% of them fall below the model line, and' ELSE '' END || ' ' || unit_name || ' runs ' || {text2('abs(gap)')} || ' log units ' ||
  CASE WHEN gap < 0 THEN 'more underfunded than' ELSE 'better funded than' END || ' that regional average.' END AS region_text
FROM x""", uses="units")
def report_unit_summary(s: Stages) -> DataFrame:
    return reports.unit_summary(s.units, WORDS)


def _facts(s: Stages) -> DataFrame:
    return reports.facts(s.units, s.regional, s.projection)


@query("report_facts", """
SELECT u.unit, u.profile, u.tier_rank, r.status AS region_status, round(r.gap_base, 6) AS gap_base, round(r.gap_horizon, 6) AS gap_horizon,
       round(p.fit_horizon, 4) AS fit_horizon, round(p.annual_pct, 4) AS annual_pct, p.trend_significant
FROM units u LEFT JOIN regional r ON r.region = u.region LEFT JOIN projection p ON p.unit = u.unit""", uses="all")
def report_facts(s: Stages) -> DataFrame:
    return _facts(s).select(
        "unit", "profile", "tier_rank", "region_status", *r6("gap_base", "gap_horizon"),
        rnd("fit_horizon", 4).alias("fit_horizon"), rnd("annual_pct", 4).alias("annual_pct"), "trend_significant",
    )


@query("report_facts_text", f"""
SELECT u.unit, concat_ws(chr(10), 'Country: ' || u.unit_name || ' (region: ' || u.region || ')', 'Funding profile: ' || u.profile,
 'Mean misallocation residual: ' || {signed2('score_mean')} || ' (negative means it receives less adaptation aid than the model predicts)',
 'Within its ' || u.tier || ' income tier, ranks ' || tier_rank || ' of ' || tier_n || ' by misallocation (1 = most underfunded)',
 'Mean vulnerability: ' || {text2('need_mean')}, 'Mean annual adaptation aid observed: $' || {text2('outcome_mean')} || ' million over ' || u.n_periods || ' years',
 CASE WHEN thin_data THEN 'Data caveat: based on only one or two years, so figures are uncertain.' END,
 'Regional gap for ' || u.region || ' is ' || r.status || ': ' || {signed2('r.gap_base')} || ' in 2001, projected to ' || {signed2('r.gap_horizon')} || ' by 2008.',
 'If its 1995 to 2001 trend holds, adaptation aid is projected near $' || {grouped0('p.fit_horizon')} || ' million by 2008 (' || {signed2('p.pct_change', 0)} || '% vs 2001, ' || {signed2('p.annual_pct', 1)} ||
 '% per year, trend ' || CASE WHEN p.trend_significant THEN 'statistically significant' ELSE 'not statistically significant' END || ').') AS facts
FROM units u LEFT JOIN regional r ON r.region = u.region LEFT JOIN projection p ON p.unit = u.unit""", uses="all")
def report_facts_text(s: Stages) -> DataFrame:
    return reports.facts_text(_facts(s), s.periods[0], BASE_PERIOD, HORIZON, WORDS)


@query("report_fit_by_tier", """
WITH t AS (SELECT * FROM scored UNION ALL BY NAME SELECT * REPLACE ('All' AS tier) FROM scored)
FINAL SELECT tier, count(*) AS n, round(CASE WHEN count(*) > 2 THEN corr(predicted, log_outcome) END, 6) AS r, round(avg((abs(score) > 1)::INT), 6) AS share_large,
 arg_min(unit_name, score) AS widest_unit, arg_min(period, score) AS widest_period, round(min(score), 6) AS widest_score FROM t GROUP BY tier""", uses="scored")
def report_fit_by_tier(s: Stages) -> DataFrame:
    rows = reports.fit_by_tier(s.scored)
    return rows.select("tier", "n", *r6("r", "share_large"), "widest_unit", "widest_period", *r6("widest_score"))


@query("report_trajectory", """
SELECT unit, period, round(score, 6) AS score, round(CASE WHEN count(*) OVER (PARTITION BY unit) >= 3 THEN avg(score) OVER (PARTITION BY unit) END, 6) AS unit_mean,
 CASE WHEN score < 0 THEN 'below' ELSE 'above' END AS side FROM scored""", uses="scored")
def report_trajectory(s: Stages) -> DataFrame:
    return reports.trajectory(s.scored).select("unit", "period", *r6("score", "unit_mean"), "side")


@query("report_trajectory_stats", """
SELECT unit, n, n_below, round(m, 6) AS mean_score, unit_name || CASE WHEN m < -0.5 THEN ' has been persistently underfunded' WHEN m > 0.5 THEN ' has been consistently over-resourced' ELSE ' tracks the model closely' END AS headline,
 CASE WHEN n < 3 THEN 'Too few years' WHEN sl < -0.01 THEN 'Narrowing' WHEN sl > 0.01 THEN 'Widening' ELSE 'Steady' END AS trend
FROM (SELECT unit, any_value(unit_name) AS unit_name, count(*) AS n, count(*) FILTER (score < 0) AS n_below, avg(score) AS m, regr_slope(abs(score), period - 2000) AS sl FROM scored GROUP BY unit) x""", uses="scored")
def report_trajectory_stats(s: Stages) -> DataFrame:
    return reports.trajectory_stats(s.scored).select("unit", "n", "n_below", *r6("mean_score"), "headline", "trend")


@query("report_regional_cards", """
WITH c AS (SELECT region, abs(gap_horizon) - abs(gap_base) AS d FROM regional WHERE status = 'closing' AND gap_base < 0 ORDER BY slope, region LIMIT 1),
w AS (SELECT region, abs(gap_horizon) - abs(gap_base) AS d FROM regional WHERE status = 'widening' AND gap_base < 0 ORDER BY slope, region LIMIT 1),
k AS (SELECT count(*) AS n_regions, count(*) FILTER (status = 'widening') AS n_widening, count(*) FILTER (status = 'closing') AS n_closing FROM regional)
FINAL SELECT n_regions, n_widening, n_closing, n_widening - n_closing AS balance, c.region AS closing_region, round(c.d, 6) AS closing_change, w.region AS widening_region, round(w.d, 6) AS widening_change
FROM k LEFT JOIN c ON true LEFT JOIN w ON true""", uses="regional")
def report_regional_cards(s: Stages) -> DataFrame:
    cards = reports.regional_cards(s.regional)
    return cards.select("n_regions", "n_widening", "n_closing", "balance", "closing_region", *r6("closing_change"), "widening_region", *r6("widening_change"))


MISSING = {"need": "Need", "wealth": "Wealth", "gov": "Governance", "tier": "Tier"}


@query("report_exclusions", f"""
SELECT p.unit, p.unit_name, concat_ws('; ', CASE WHEN count(need) = 0 THEN 'Need' END, CASE WHEN count(wealth) = 0 THEN 'Wealth' END, CASE WHEN count(gov) = 0 THEN 'Governance' END, CASE WHEN count(tier) = 0 THEN 'Tier' END) AS missing_inputs,
 min(period) || ' to ' || max(period) AS periods, round(sum(outcome), 6) AS total, '$' || {grouped0('sum(outcome)')} || 'M' AS total_text
FROM panel p WHERE unit NOT IN (SELECT unit FROM scored) GROUP BY ALL ORDER BY total DESC""", uses="scored")
def report_exclusions(s: Stages) -> DataFrame:
    rows = reports.exclusions(s.panel, s.scored, MISSING).orderBy(F.col("total").desc(), "unit")
    return rows.select("unit", "unit_name", "missing_inputs", "periods", *r6("total"), "total_text")


@query("report_meaning", """
SELECT unit, CASE
  WHEN profile IN ('Chronically Underfunded', 'Underfunded') AND direction = 'Rising'
    THEN unit_name || ' starts ' || lower(profile) || '; its adaptation aid rises, but rising with everyone else does not close the gap.'
  WHEN profile IN ('Chronically Underfunded', 'Underfunded') AND direction = 'Falling'
    THEN unit_name || ' is ' || lower(profile) || ' and its adaptation aid is falling, so the shortfall grows.'
  WHEN profile IN ('Chronically Underfunded', 'Underfunded') AND direction = 'Flat'
    THEN unit_name || ' is ' || lower(profile) || ' and its adaptation aid stays level, so the shortfall remains.'
  WHEN profile = 'Over-Resourced' AND direction = 'Rising'
    THEN unit_name || ' is over-resourced and its adaptation aid still rises, so the lead grows.'
  WHEN profile = 'Over-Resourced' AND direction = 'Falling'
    THEN unit_name || ' is over-resourced and its adaptation aid is falling, back toward need.'
  WHEN profile = 'Over-Resourced' AND direction = 'Flat'
    THEN unit_name || ' is over-resourced and its adaptation aid stays level, so the lead remains.'
  WHEN profile = 'Adequately Funded' AND direction = 'Rising' THEN unit_name || ' tracks need; a rising path keeps it near the model line.'
  WHEN profile = 'Adequately Funded' AND direction = 'Falling' THEN unit_name || ' tracks need; a falling path keeps it near the model line for now.'
  WHEN profile = 'Adequately Funded' AND direction = 'Flat' THEN unit_name || ' tracks need; a flat path keeps it near the model line.' END
  || CASE WHEN trend_significant THEN '' ELSE ' The trend is not statistically significant (' || n_periods || ' observed periods): an illustration, not a forecast.' END AS meaning
FROM projection""", uses="projection")
def report_meaning(s: Stages) -> DataFrame:
    return reports.meanings(s.projection, WORDS)


@query("quality_gate", """
SELECT count(*) AS n_rows, count(DISTINCT unit) AS n_units, count(*) - count(need) AS need_missing, count(*) - count(tier) AS tier_missing FROM model""", uses="model")
def quality_gate(s: Stages) -> DataFrame:
    counted = s.table("orders").agg(
        F.countDistinct("o_custkey", F.year("o_orderdate")).alias("cells"), F.countDistinct("o_custkey").alias("units")
    ).first()
    quality.expect(s.panel, n_rows=counted["cells"], n_units=counted["units"], not_null=["unit_name", "region"])
    quality.require(s.model_figures, not_null=["outcome", *INPUTS, "tier"])
    return quality.measure(s.model, "unit", ["need", "tier"])


@query("report_coverage", """
SELECT (SELECT count(*) FROM panel) AS n_rows, count(*) AS n_scored, (SELECT count(*) FROM panel) - count(*) AS n_unscored, count(DISTINCT unit) AS n_units_scored FROM scored""", uses="scored")
def report_coverage(s: Stages) -> DataFrame:
    return reports.coverage(s.panel, s.scored)


@query("report_region_lines", """
SELECT r.region, g.period, round(x.gap, 6) AS observed, round(r.gap_base + r.slope * (g.period - 2001), 6) AS fitted, round(r.gap_horizon, 6) AS gap_horizon
FROM regional r CROSS JOIN (SELECT unnest(range(min(period), 2009))::INTEGER AS period FROM panel) g LEFT JOIN series x ON x.region = r.region AND x.period = g.period""", uses="regional")
def report_region_lines(s: Stages) -> DataFrame:
    lines = reports.region_lines(s.scored, s.regional, s.periods[0], HORIZON)
    return lines.select("region", "period", *r6("observed", "fitted", "gap_horizon")).orderBy("gap_horizon", "region", "period")


@query("report_fit_rows", """
SELECT unit, period, CASE tier WHEN 'L' THEN 'Low' WHEN 'LM' THEN 'Lower-middle' END AS tier_label, round(predicted, 6) AS predicted, round(log_outcome, 6) AS log_outcome, round(score, 6) AS score
FROM scored WHERE tier IN ('L', 'LM')""", uses="scored")
def report_fit_rows(s: Stages) -> DataFrame:
    rows = reports.fit_rows(s.scored, fixed.HEADLINE_TIERS)
    return rows.select("unit", "period", "tier_label", *r6("predicted", "log_outcome", "score"))
