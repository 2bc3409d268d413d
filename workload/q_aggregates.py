"""Aggregations and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.operators import aggregates as agg
from allocora.operators import concentration as conc
from allocora.operators.trend import enough_history
from allocora.plans.order_panel import PREDICTORS
from allocora.plans.unit_table import unit_scores
from workload.registry import Stages, query, r4up, r6, r9, rnd

MEASURES = ["outcome", "need", "composite", "wealth", "gov"]


def _ln_panel(s: Stages) -> DataFrame:
    return s.panel.filter("outcome > 0").withColumn("ln_value", F.ln("outcome"))


@query("agg_sum_by_key", """
SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS period, round(coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 0), 2) AS value
FROM orders GROUP BY ALL""", uses="")
def agg_sum_by_key(s: Stages) -> DataFrame:
    rows = s.table("orders").select(
        F.col("o_custkey").alias("unit"),
        F.year("o_orderdate").alias("period"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
    )
    return agg.sum_by_key(rows, ["unit", "period"], "value").withColumn("value", rnd("value", 2))


@query("agg_unit_scores", """
SELECT unit, n_periods, round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std, round(need_mean, 9) AS need_mean,
       round(outcome_mean, 8) AS outcome_mean, round(wealth_mean + 1e-9, 4) AS wealth_mean, round(gov_mean, 9) AS gov_mean, round(ratio_mean + 1e-9, 4) AS ratio_mean
FROM units""", uses="units")
def agg_unit_scores(s: Stages) -> DataFrame:
    return s.units.select(
        "unit", "n_periods", *r6("score_mean", "score_std"), *r9("need_mean", "gov_mean"),
        rnd("outcome_mean", 8).alias("outcome_mean"), *r4up("wealth_mean", "ratio_mean"),
    )


@query("agg_unit_scores_all_periods", """
SELECT p.unit, CAST(count(*) AS INTEGER) AS n_periods, round(avg(c.score), 6) AS score_mean, round(stddev_samp(c.score), 6) AS score_std
FROM panel p LEFT JOIN scored c ON c.unit = p.unit AND c.period = p.period GROUP BY p.unit""", uses="scored")
def agg_unit_scores_all_periods(s: Stages) -> DataFrame:
    scores = s.scored.select("unit", "period", "score")
    rows = s.panel.join(scores, ["unit", "period"], "left")
    return unit_scores(rows).select("unit", "n_periods", *r6("score_mean", "score_std"))


@query("agg_region_mean_of_means", """
SELECT region, round(avg(score_mean), 6) AS mean_score, count(*) AS n FROM units GROUP BY region""", uses="units")
def agg_region_mean_of_means(s: Stages) -> DataFrame:
    return s.units.groupBy("region").agg(rnd(F.avg("score_mean"), 6).alias("mean_score"), F.count("*").alias("n"))


@query("agg_region_period_mean", """
SELECT region, period, round(avg(score), 6) AS gap FROM scored GROUP BY region, period""", uses="scored")
def agg_region_period_mean(s: Stages) -> DataFrame:
    from allocora.operators.trend import region_series

    return region_series(s.scored).select("region", "period", *r6("gap"))


@query("agg_structural_means", """
SELECT 'tier' AS cut, tier AS level, round(avg(outcome), 4) AS mean_outcome, round(avg(need), 6) AS mean_need FROM panel WHERE tier IS NOT NULL GROUP BY tier
UNION ALL SELECT 'region', region, round(avg(outcome), 4), round(avg(need), 6) FROM panel GROUP BY region""")
def agg_structural_means(s: Stages) -> DataFrame:
    def cut(column: str) -> DataFrame:
        return s.panel.filter(F.col(column).isNotNull()).groupBy(F.lit(column).alias("cut"), F.col(column).alias("level")).agg(
            rnd(F.avg("outcome"), 4).alias("mean_outcome"), rnd(F.avg("need"), 6).alias("mean_need")
        )

    return cut("tier").unionByName(cut("region"))


@query("agg_distinct_count", """
SELECT count(DISTINCT unit) AS n_units, count(DISTINCT period) AS n_periods, count(DISTINCT tier) AS n_tiers FROM panel""")
def agg_distinct_count(s: Stages) -> DataFrame:
    return s.panel.agg(
        F.countDistinct("unit").alias("n_units"),
        F.countDistinct("period").alias("n_periods"),
        F.countDistinct("tier").alias("n_tiers"),
    )


@query("agg_value_counts", """
SELECT tier, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM panel), 6) AS pct FROM panel GROUP BY tier""")
def agg_value_counts(s: Stages) -> DataFrame:
    return agg.value_counts(s.panel, "tier").select("tier", "n", *r6("pct"))


@query("agg_crosstab", """
SELECT p.profile, count(*) FILTER (tier = 'L') AS "L", count(*) FILTER (tier = 'LM') AS "LM", count(*) FILTER (tier = 'UM') AS "UM", count(*) FILTER (tier = 'H') AS "H"
FROM (VALUES ('Chronically Underfunded'), ('Underfunded'), ('Adequately Funded'), ('Over-Resourced')) p(profile) LEFT JOIN units u ON u.profile = p.profile GROUP BY p.profile""", uses="units")
def agg_crosstab(s: Stages) -> DataFrame:
    return agg.crosstab(s.units, "profile", "tier", fixed.TIER_ORDER, rows=fixed.PROFILES)


def _describe_sql(c: str) -> str:
    figures = {
        "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})", "skew": f"skewness({c})",
        "q25": f"quantile_cont({c}, 0.25)", "median": f"median({c})", "q75": f"quantile_cont({c}, 0.75)",
    }
    rounded = ", ".join(f"round({e} + 1e-9, 4) AS {name}" for name, e in figures.items())
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, {rounded} FROM panel"


@query("agg_describe", " UNION ALL ".join(_describe_sql(c) for c in MEASURES))
def agg_describe(s: Stages) -> DataFrame:
    figures = ("mean", "std", "min", "max", "skew", "q25", "median", "q75")
    return agg.describe(s.panel, MEASURES).select("column", "n", *r4up(*figures))


@query("agg_skewness", """
SELECT round(skewness(outcome), 6) AS skew_raw, round(skewness(ln(outcome)), 6) AS skew_ln FROM panel WHERE outcome > 0""")
def agg_skewness(s: Stages) -> DataFrame:
    from allocora.functions.numeric import skewness_corrected

    return _ln_panel(s).agg(
        rnd(skewness_corrected("outcome"), 6).alias("skew_raw"), rnd(skewness_corrected("ln_value"), 6).alias("skew_ln")
    )


@query("agg_missing_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct FROM panel"
    for c in PREDICTORS))
def agg_missing_profile(s: Stages) -> DataFrame:
    return agg.missing_profile(s.panel, PREDICTORS).select("column", "missing", *r6("pct"))


@query("agg_missing_footprint", """
SELECT unit, count(*) FILTER (need IS NULL OR composite IS NULL OR wealth IS NULL OR gov IS NULL OR tier IS NULL) AS rows_missing, """
+ ", ".join(f"count({c}) = 0 AS {c}_never" for c in PREDICTORS) + " FROM panel GROUP BY unit")
def agg_missing_footprint(s: Stages) -> DataFrame:
    return agg.missing_footprint(s.panel, PREDICTORS)


@query("agg_duplicates", """
SELECT (SELECT count(*) - count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) FROM lineitem) AS duplicate_rows,
       (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) AS duplicate_keys""", uses="")
def agg_duplicates(s: Stages) -> DataFrame:
    return agg.duplicates(s.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg_panel_balance", """
SELECT count(*) AS n_rows, count(DISTINCT unit) AS n_units, count(DISTINCT period) AS n_periods,
       count(DISTINCT unit) * count(DISTINCT period) AS possible, count(DISTINCT unit) * count(DISTINCT period) - count(*) AS absent FROM panel""")
def agg_panel_balance(s: Stages) -> DataFrame:
    return agg.panel_balance(s.panel)


@query("agg_modal_tier", """
WITH c AS (SELECT unit, tier, count(*) AS c, max(period) AS last FROM panel WHERE tier IS NOT NULL GROUP BY unit, tier)
FINAL SELECT unit, tier AS modal_tier FROM c QUALIFY row_number() OVER (PARTITION BY unit ORDER BY c DESC, last DESC) = 1""")
def agg_modal_tier(s: Stages) -> DataFrame:
    return agg.modal_level(s.panel, "unit", "tier", "period", "modal_tier")


@query("agg_recent_tier", """
SELECT unit, arg_max(tier, period) FILTER (tier IS NOT NULL) AS recent_tier FROM panel GROUP BY unit""")
def agg_recent_tier(s: Stages) -> DataFrame:
    return s.panel.groupBy("unit").agg(agg.recent_level("tier", "period").alias("recent_tier"))


@query("agg_reclassified_units", """
SELECT count(*) AS n_units, count(*) FILTER (n > 1) AS n_changed FROM (SELECT unit, count(DISTINCT tier) AS n FROM panel GROUP BY unit) x""")
def agg_reclassified_units(s: Stages) -> DataFrame:
    return agg.reclassified_units(s.panel, "unit", "tier")


@query("agg_tier_disagreement", """
SELECT count(*) AS n_units, count(*) FILTER (tier <> tier_recent) AS n_differ FROM units""", uses="units")
def agg_tier_disagreement(s: Stages) -> DataFrame:
    return s.units.agg(F.count("*").alias("n_units"), F.count_if(F.col("tier") != F.col("tier_recent")).alias("n_differ"))


@query("agg_conditional_share", """
SELECT round(avg((outcome < 100)::INT), 6) AS below_100, round(avg((outcome > 500)::INT), 6) AS above_500,
       round(avg(coalesce(tier = 'H', false)::INT), 6) AS high_tier FROM panel""")
def agg_conditional_share(s: Stages) -> DataFrame:
    shares = agg.conditional_shares(
        s.panel,
        {"below_100": F.col("outcome") < 100, "above_500": F.col("outcome") > 500, "high_tier": F.col("tier") == "H"},
    )
    return shares.select(*r6("below_100", "above_500", "high_tier"))


@query("agg_corr_by_group", """
SELECT tier, period < 1998 AS early, count(*) AS n, round(corr(need, ln(outcome)), 6) AS r FROM panel
WHERE outcome > 0 AND need IS NOT NULL GROUP BY ALL HAVING count(*) > 2""")
def agg_corr_by_group(s: Stages) -> DataFrame:
    rows = _ln_panel(s).withColumn("early", F.col("period") < 1998)
    return agg.correlation_by_group(rows, "need", "ln_value", ["tier", "early"]).select("tier", "early", "n", *r6("r"))


@query("agg_spearman", """
WITH r AS (
  SELECT rank() OVER (ORDER BY round(need, 9)) + (count(*) OVER (PARTITION BY round(need, 9)) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY round(outcome, 6)) + (count(*) OVER (PARTITION BY round(outcome, 6)) - 1) / 2.0 AS ry
  FROM panel WHERE need IS NOT NULL AND outcome IS NOT NULL)
FINAL SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def agg_spearman(s: Stages) -> DataFrame:
    rows = s.panel.select(*r9("need"), *r6("outcome"))
    return agg.spearman(rows, "need", "outcome").select("n", *r6("rho"))


CORR = ["log_outcome", "need", "composite", "log_wealth", "gov"]


@query("agg_corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM model" for a in CORR for b in CORR), uses="model")
def agg_corr_matrix(s: Stages) -> DataFrame:
    return agg.correlation_matrix(s.model, CORR).select("a", "b", *r6("r"))


@query("agg_having_min_periods", """
SELECT unit, count(DISTINCT period) AS n_periods FROM panel GROUP BY unit HAVING count(DISTINCT period) >= 5""")
def agg_having_min_periods(s: Stages) -> DataFrame:
    return enough_history(s.panel)


@query("agg_topk_share", """
WITH t AS (SELECT unit, sum(outcome) AS v FROM panel GROUP BY unit),
r AS (SELECT v, row_number() OVER (ORDER BY v DESC, unit) AS rn FROM t),
ks AS (SELECT unnest([5, 10, 15, 20, 30]) AS k)
FINAL SELECT CAST(k AS INTEGER) AS k, round(sum(v) / (SELECT sum(v) FROM t), 6) AS share FROM ks JOIN r ON rn <= k GROUP BY k""")
def agg_topk_share(s: Stages) -> DataFrame:
    totals = s.panel.groupBy("unit").agg(F.sum("outcome").alias("v"))
    return conc.top_k_shares(totals, "v", "unit").select("k", *r6("share"))


@query("agg_unit_shares", """
SELECT unit, round(sum(outcome), 6) AS v, round(100 * sum(outcome) / (SELECT sum(outcome) FROM panel), 8) AS pct FROM panel GROUP BY unit""")
def agg_unit_shares(s: Stages) -> DataFrame:
    whole = s.panel.agg(F.sum("outcome")).scalar()
    totals = s.panel.groupBy("unit").agg(F.sum("outcome").alias("v"))
    return totals.select("unit", rnd("v", 6).alias("v"), rnd(100 * F.col("v") / whole, 8).alias("pct"))


GINI = """SELECT {by} count(*) AS n, round(2 * sum(rn * v) / (count(*) * sum(v)) - (count(*) + 1) * 1.0 / count(*), 6) AS gini
FROM (SELECT *, row_number() OVER ({part} ORDER BY v) AS rn FROM {src}) x {group}"""


@query("conc_gini", GINI.format(by="", part="", src="(SELECT unit, sum(outcome) AS v FROM panel GROUP BY unit) t", group=""))
def conc_gini(s: Stages) -> DataFrame:
    totals = s.panel.groupBy("unit").agg(F.sum("outcome").alias("v"))
    return conc.gini(totals, "v").select("n", *r6("gini"))


@query("conc_gini_by_region", GINI.format(
    by="region,", part="PARTITION BY region", src="(SELECT region, outcome_mean AS v FROM units) t", group="GROUP BY region"), uses="units")
def conc_gini_by_region(s: Stages) -> DataFrame:
    return conc.gini(s.units, "outcome_mean", ["region"]).select("region", "n", *r6("gini"))


@query("conc_lorenz", """
WITH p AS (SELECT row_number() OVER (ORDER BY outcome_mean, unit) AS rn, sum(outcome_mean) OVER (ORDER BY outcome_mean, unit) AS c FROM units),
z AS (SELECT count(*) AS n, sum(outcome_mean) AS s FROM units)
FINAL SELECT CAST(rn AS BIGINT) AS point, round(rn * 1.0 / n, 6) AS cum_units, round(c / s, 6) AS cum_value FROM p, z UNION ALL SELECT 0, 0.0, 0.0""", uses="units")
def conc_lorenz(s: Stages) -> DataFrame:
    return conc.lorenz(s.units, "outcome_mean").select("point", *r6("cum_units", "cum_value"))


@query("conc_facts", """
WITH p AS (SELECT row_number() OVER (ORDER BY outcome_mean, unit) AS rn, sum(outcome_mean) OVER (ORDER BY outcome_mean, unit) AS c FROM units),
z AS (SELECT count(*) AS n, sum(outcome_mean) AS s FROM units),
h AS (SELECT min(rn) AS half FROM p, z WHERE c / s >= 0.5)
FINAL SELECT n, half AS half_index, round(half * 1.0 / n, 6) AS half_x, round((n - half) * 1.0 / n, 6) AS top_half_share,
       round((SELECT c FROM p WHERE rn = round_even(n / 2.0, 0)) / s, 6) AS bottom_half_share,
       round(1 - (SELECT c FROM p WHERE rn = n - 15) / s, 6) AS top_share
FROM z, h""", uses="units")
def conc_facts(s: Stages) -> DataFrame:
    return conc.concentration_facts(s.units, "outcome_mean").select(
        "n", "half_index", *r6("half_x", "top_half_share", "bottom_half_share", "top_share")
    )


@query("agg_argmin_row", """
SELECT unit, unit_name, period, round(score, 6) AS score FROM scored ORDER BY scored.score, unit LIMIT 1""", uses="scored")
def agg_argmin_row(s: Stages) -> DataFrame:
    return agg.extreme_row(s.scored, "score", ["unit", "unit_name", "period", "score"], "unit").select(
        "unit", "unit_name", "period", *r6("score")
    )


@query("agg_envelope", """
SELECT round(least(min(predicted), min(log_outcome)), 6) AS lo, round(greatest(max(predicted), max(log_outcome)), 6) AS hi,
       round(max(abs(predicted)), 6) AS max_abs FROM scored""", uses="scored")
def agg_envelope(s: Stages) -> DataFrame:
    return agg.envelope(s.scored, "predicted", "log_outcome").select(*r6("lo", "hi", "max_abs"))


@query("agg_histogram", """
WITH b AS (SELECT min(outcome) AS lo, max(outcome) AS hi FROM panel),
c AS (SELECT CAST(least(floor((outcome - lo) / (hi - lo) * 60), 59) AS INTEGER) AS bin, count(*) AS n FROM panel, b GROUP BY 1)
FINAL SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / 60), 4) AS left_edge, round(lo + (g.bin + 1) * ((hi - lo) / 60), 4) AS right_edge, coalesce(c.n, 0) AS n
FROM (SELECT unnest(range(60)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""")
def agg_histogram(s: Stages) -> DataFrame:
    bins = agg.histogram(s.panel, "outcome", 60)
    return bins.select("bin", rnd("left_edge", 4).alias("left_edge"), rnd("right_edge", 4).alias("right_edge"), "n")


@query("agg_box_stats", """
WITH q AS (SELECT tier, count(*) AS n, quantile_cont(score_mean, 0.25) AS q1, median(score_mean) AS median, quantile_cont(score_mean, 0.75) AS q3 FROM units GROUP BY tier)
FINAL SELECT q.tier, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(score_mean) FILTER (score_mean >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(score_mean) FILTER (score_mean <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
FROM q JOIN units u ON u.tier = q.tier GROUP BY ALL""", uses="units")
def agg_box_stats(s: Stages) -> DataFrame:
    return agg.box_stats(s.units, "score_mean", ["tier"]).select(
        "tier", "n", *r6("q1", "median", "q3", "whisker_low", "whisker_high")
    )


@query("agg_box_stats_missing_group", """
WITH v AS (SELECT CASE WHEN n_periods >= 5 THEN tier END AS tier, score_mean FROM units),
q AS (SELECT tier, count(*) AS n, quantile_cont(score_mean, 0.25) AS q1, median(score_mean) AS median, quantile_cont(score_mean, 0.75) AS q3 FROM v GROUP BY tier)
FINAL SELECT q.tier, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(score_mean) FILTER (score_mean >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(score_mean) FILTER (score_mean <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
FROM q JOIN v u ON u.tier IS NOT DISTINCT FROM q.tier GROUP BY ALL""", uses="units")
def agg_box_stats_missing_group(s: Stages) -> DataFrame:
    rows = s.units.select("score_mean", F.when(F.col("n_periods") >= 5, F.col("tier")).alias("tier"))
    return agg.box_stats(rows, "score_mean", ["tier"]).select("tier", "n", *r6("q1", "median", "q3", "whisker_low", "whisker_high"))


@query("agg_flag_counts", " UNION ALL ".join(
    f"SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS n_rows, round(100.0 * sum({f}) / count(*), 6) AS pct, count(DISTINCT CASE WHEN {f} = 1 THEN unit END) AS n_units FROM {src}"
    for f, src in (("flag_a", "panel"), ("flag_b", "panel"), ("neither", "(SELECT *, CASE WHEN flag_a = 0 AND flag_b = 0 THEN 1 ELSE 0 END AS neither FROM panel) x"))))
def agg_flag_counts(s: Stages) -> DataFrame:
    rows = s.panel.withColumn("neither", ((F.col("flag_a") == 0) & (F.col("flag_b") == 0)).cast("int"))
    return agg.flag_counts(rows, ["flag_a", "flag_b", "neither"]).select("flag", "n_rows", *r6("pct"), "n_units")


@query("quality_ranges", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
    + ("count(*) FILTER (outcome <= 0)" if c == "outcome" else "NULL::BIGINT") + " AS not_positive FROM panel"
    for c in MEASURES))
def quality_ranges(s: Stages) -> DataFrame:
    return agg.value_ranges(s.panel, MEASURES, "outcome").select(
        "column", rnd("min", 4).alias("min"), rnd("max", 4).alias("max"), "not_positive"
    )
