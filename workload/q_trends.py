"""Trends, projections and rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.operators import rank_tests, trend
from allocora.plans import reports
from allocora.plans.order_panel import BASE_PERIOD, HORIZON
from workload import sql
from workload.registry import Stages, query, r6, rnd

P_SQL = sql.p_value("r2", "n")


def _unit_fits(s: Stages) -> DataFrame:
    rows = s.panel.select("unit", "period", F.log1p("outcome").alias("v"))
    return trend.trend_fit(rows, ["unit"], "v", origin=BASE_PERIOD)


@query("trend_unit_fit", """
SELECT unit, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM fits WHERE n_periods >= 5""", uses="projection")
def trend_unit_fit(s: Stages) -> DataFrame:
    return _unit_fits(s).filter("n_periods >= 5").select("unit", "n", *r6("slope", "intercept", "r2"))


@query("trend_unit_pvalue", f"SELECT unit, round({P_SQL}, 6) AS p FROM fits", uses="projection")
def trend_unit_pvalue(s: Stages) -> DataFrame:
    return _unit_fits(s).select("unit", *r6("p"))


PROJECTED = ("fit_base", "fit_horizon", "annual_pct", "pct_change")


@query("trend_projection", """
SELECT unit, n_periods, profile, tier, region, """ + ", ".join(f"round({c}, 4) AS {c}" for c in PROJECTED) + """, trend_significant, direction FROM projection""", uses="projection")
def trend_projection(s: Stages) -> DataFrame:
    attributes = ["unit_name", "region", "profile", "tier"]
    rows = trend.unit_projection(s.panel, s.units, attributes, BASE_PERIOD, HORIZON)
    return rows.select(
        "unit", "n_periods", "profile", "tier", "region", *[rnd(c, 4).alias(c) for c in PROJECTED], "trend_significant", "direction"
    )


@query("label_direction", "SELECT direction, count(*) AS n FROM projection GROUP BY direction", uses="projection")
def label_direction(s: Stages) -> DataFrame:
    return s.projection.groupBy("direction").agg(F.count("*").alias("n"))


@query("agg_direction_crosstab", """
SELECT p.profile, count(*) FILTER (direction = 'Rising') AS "Rising", count(*) FILTER (direction = 'Falling') AS "Falling", count(*) FILTER (direction = 'Flat') AS "Flat"
FROM (VALUES ('Chronically Underfunded'), ('Underfunded'), ('Adequately Funded'), ('Over-Resourced')) p(profile) LEFT JOIN projection q ON q.profile = p.profile GROUP BY p.profile""", uses="projection")
def agg_direction_crosstab(s: Stages) -> DataFrame:
    from allocora.operators.aggregates import crosstab

    return crosstab(s.projection, "profile", "direction", ["Rising", "Falling", "Flat"], rows=fixed.PROFILES)


@query("trend_excluded_units", """
SELECT p.unit, u.unit_name, u.tier, count(DISTINCT p.period) AS n_periods FROM panel p JOIN units u ON u.unit = p.unit
GROUP BY ALL HAVING count(DISTINCT p.period) < 5""", uses="units")
def trend_excluded_units(s: Stages) -> DataFrame:
    history = s.panel.groupBy("unit").agg(F.countDistinct("period").alias("n_periods")).filter(F.col("n_periods") < fixed.MIN_HISTORY)
    return history.join(s.units.select("unit", "unit_name", "tier"), "unit").select("unit", "unit_name", "tier", "n_periods")


GAPS = ("slope", "p", "gap_base", "gap_horizon")


@query("trend_region_gap", "SELECT region, " + ", ".join(f"round({c}, 6) AS {c}" for c in GAPS) + ", status FROM regional", uses="regional")
def trend_region_gap(s: Stages) -> DataFrame:
    return s.regional.select("region", *r6(*GAPS), "status")


@query("label_status", "SELECT status, count(*) AS n FROM regional GROUP BY status", uses="regional")
def label_status(s: Stages) -> DataFrame:
    return s.regional.groupBy("status").agg(F.count("*").alias("n"))


@query("trend_theil_sen", """
SELECT a.region, round(median((b.gap - a.gap) / (b.period - a.period)), 6) AS theil_sen
FROM series a JOIN series b ON a.region = b.region AND a.period < b.period GROUP BY a.region""", uses="regional")
def trend_theil_sen(s: Stages) -> DataFrame:
    return trend.theil_sen(trend.region_series(s.scored), ["region"], "gap").select("region", *r6("theil_sen"))


@query("trend_theil_sen_units", """
SELECT u.unit, round(median((b.score - a.score) / (b.period - a.period)), 6) AS theil_sen
FROM units u LEFT JOIN scored a ON a.unit = u.unit LEFT JOIN scored b ON a.unit = b.unit AND a.period < b.period GROUP BY u.unit""", uses="units")
def trend_theil_sen_units(s: Stages) -> DataFrame:
    return trend.theil_sen(s.scored, ["unit"], "score").select("unit", *r6("theil_sen"))


@query("trend_drop_endpoint", """
SELECT region, round(regr_slope(gap, period - 2001), 6) AS slope, round(regr_slope(gap, period - 2001) FILTER (period < 2001), 6) AS slope_without_last
FROM series GROUP BY region""", uses="regional")
def trend_drop_endpoint(s: Stages) -> DataFrame:
    slopes = trend.slope_without_last(trend.region_series(s.scored), ["region"], "gap", BASE_PERIOD)
    return slopes.select("region", *r6("slope", "slope_without_last"))


@query("trend_members_deepening", """
SELECT region, count(*) AS n_units, count(*) FILTER (slope < 0) AS n_deepening
FROM (SELECT region, unit, regr_slope(score, period - 2001) AS slope FROM scored GROUP BY region, unit HAVING count(DISTINCT period) >= 5) x GROUP BY region""", uses="scored")
def trend_members_deepening(s: Stages) -> DataFrame:
    return trend.members_deepening(s.scored, "region", "unit", "period", "score")


GROWTH_SQL = """
WITH g AS (SELECT 'all' AS trends, profile, annual_pct FROM projection UNION ALL SELECT 'significant', profile, annual_pct FROM projection WHERE trend_significant)
FINAL """


@query("trend_growth_by_profile", GROWTH_SQL + """
SELECT trends, profile, round(median(annual_pct), 4) AS median, round(avg(annual_pct), 4) AS mean, count(*) AS n FROM g GROUP BY trends, profile""", uses="projection")
def trend_growth_by_profile(s: Stages) -> DataFrame:
    growth = reports.growth_by_profile(s.projection)
    return growth.select("trends", "profile", rnd("median", 4).alias("median"), rnd("mean", 4).alias("mean"), "n")


@query("trend_growth_verdict", GROWTH_SQL + """
SELECT round(lowest, 4) AS lowest, round(highest, 4) AS highest, CASE WHEN lowest >= highest THEN 'CLOSING' ELSE 'ENTRENCHING' END AS verdict
FROM (SELECT median(annual_pct) FILTER (profile = 'Chronically Underfunded') AS lowest, median(annual_pct) FILTER (profile = 'Over-Resourced') AS highest FROM g WHERE trends = 'all') x""", uses="projection")
def trend_growth_verdict(s: Stages) -> DataFrame:
    verdict = reports.growth_verdict(reports.growth_by_profile(s.projection))
    return verdict.select(rnd("lowest", 4).alias("lowest"), rnd("highest", 4).alias("highest"), "verdict")


# Chi-square tail with 3 degrees of freedom: erfc(sqrt(h/2)) + sqrt(2h/pi) exp(-h/2), erfc by Simpson's rule.
CHI3 = """(SELECT 1 - 2 / sqrt(pi()) * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(i * sqrt(h / 2) / 2000, 2))) * (sqrt(h / 2) / 2000) / 3
  FROM generate_series(0, 2000) g(i)) + sqrt(2 * h / pi()) * exp(-h / 2)"""


def _kruskal_sql(where: str) -> str:
    return f"""
WITH r AS (SELECT profile, rank() OVER (ORDER BY annual_pct) + (count(*) OVER (PARTITION BY annual_pct) - 1) / 2.0 AS r, count(*) OVER () AS n FROM projection WHERE {where}),
h AS (SELECT max(n) AS n, 12.0 / (max(n) * (max(n) + 1)) * sum(s * s / c) - 3 * (max(n) + 1) AS h, count(*) AS k FROM (SELECT profile, sum(r) AS s, count(*) AS c, max(n) AS n FROM r GROUP BY profile) x)
FINAL SELECT n, CASE WHEN k = 4 THEN round(h, 6) END AS h, CASE WHEN k = 4 THEN round({CHI3}, 6) END AS p FROM h"""


def _kruskal(s: Stages, rows: DataFrame) -> DataFrame:
    found = rank_tests.kruskal(rows, "annual_pct", "profile", fixed.PROFILES)
    return s.spark.createDataFrame([(found["n"], found["h"], found["p"])], "n bigint, h double, p double").select("n", *r6("h", "p"))


@query("test_kruskal", _kruskal_sql("TRUE"), uses="projection")
def test_kruskal(s: Stages) -> DataFrame:
    return _kruskal(s, s.projection)


@query("test_kruskal_significant", _kruskal_sql("trend_significant"), uses="projection")
def test_kruskal_significant(s: Stages) -> DataFrame:
    return _kruskal(s, s.projection.filter("trend_significant"))


@query("test_mannwhitney", """
WITH r AS (SELECT profile, rank() OVER (ORDER BY annual_pct) + (count(*) OVER (PARTITION BY annual_pct) - 1) / 2.0 AS r
  FROM projection WHERE profile IN ('Chronically Underfunded', 'Over-Resourced')),
u AS (SELECT sum(r) FILTER (profile = 'Chronically Underfunded') - count(*) FILTER (profile = 'Chronically Underfunded') * (count(*) FILTER (profile = 'Chronically Underfunded') + 1) / 2.0 AS u,
  count(*) FILTER (profile = 'Chronically Underfunded') AS n1, count(*) FILTER (profile = 'Over-Resourced') AS n2 FROM r),
z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1)) AS z FROM u)
FINAL SELECT n1, n2, round(u, 6) AS u, round((SELECT 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(i * z / 2000, 2) / 2)) * (z / 2000) / 3 / sqrt(2 * pi())
  FROM generate_series(0, 2000) g(i)), 6) AS p FROM z""", uses="projection")
def test_mannwhitney(s: Stages) -> DataFrame:
    found = rank_tests.mann_whitney(s.projection, "annual_pct", "profile", fixed.PROFILES[0], fixed.PROFILES[3], method="asymptotic")
    row = (found["n1"], found["n2"], found["u"], found["p"])
    return s.spark.createDataFrame([row], "n1 bigint, n2 bigint, u double, p double").select("n1", "n2", *r6("u", "p"))


@query("trend_abs_gap", """
SELECT unit, n, round(sl, 6) AS abs_slope, CASE WHEN n < 3 THEN 'Too few years' WHEN sl < -0.01 THEN 'Narrowing' WHEN sl > 0.01 THEN 'Widening' ELSE 'Steady' END AS trend
FROM (SELECT unit, count(*) AS n, regr_slope(abs(score), period - 2000) AS sl FROM scored GROUP BY unit) x""", uses="scored")
def trend_abs_gap(s: Stages) -> DataFrame:
    return reports.trajectory_stats(s.scored).select("unit", "n", *r6("abs_slope"), "trend")


@query("trend_scatter_fit", """
SELECT count(*) AS n, round(regr_slope(ln(outcome), need), 6) AS slope, round(regr_intercept(ln(outcome), need), 6) AS intercept,
       round(regr_r2(ln(outcome), need), 6) AS r2 FROM panel WHERE outcome > 0 AND need IS NOT NULL""")
def trend_scatter_fit(s: Stages) -> DataFrame:
    y, x = F.ln("outcome"), F.col("need")
    rows = s.panel.filter((F.col("outcome") > 0) & x.isNotNull())
    return rows.agg(
        F.count("*").alias("n"), rnd(F.regr_slope(y, x), 6).alias("slope"),
        rnd(F.regr_intercept(y, x), 6).alias("intercept"), rnd(F.regr_r2(y, x), 6).alias("r2"),
    )


@query("forecast_curve", """
SELECT q.unit, g.period, round(exp(q.intercept + q.slope * g.period) - 1, 4) AS curve, round(p.outcome, 6) AS observed, CASE WHEN g.period <= 2001 THEN 'fitted' ELSE 'projected' END AS part
FROM projection q CROSS JOIN (SELECT unnest(range(min(period), 2009))::INTEGER AS period FROM panel) g LEFT JOIN panel p ON p.unit = q.unit AND p.period = g.period""", uses="projection")
def forecast_curve(s: Stages) -> DataFrame:
    curve = reports.forecast_curve(s.panel, s.projection, s.periods[0], BASE_PERIOD, HORIZON)
    return curve.select("unit", "period", rnd("curve", 4).alias("curve"), *r6("observed"), "part")
