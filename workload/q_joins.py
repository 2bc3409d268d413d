"""Joins and key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.operators import joins, sets
from allocora.operators.ranking import extremes
from allocora.operators.trend import enough_history
from workload.registry import Stages, query, r4up, r6, r9, rnd

KEYS = ["unit", "period"]


@query("panel_merge", """
SELECT p.unit, p.period, round(p.outcome, 6) AS outcome,
       CASE WHEN p.period >= 1996 THEN round(p.need, 9) END AS need,
       CASE WHEN p.period <= 2000 THEN round(p.composite, 9) END AS composite,
       round(p.wealth + 1e-9, 4) AS wealth, CASE WHEN p.flag_b = 0 THEN round(p.gov, 9) END AS gov, p.tier
FROM panel p""")
def panel_merge(s: Stages) -> DataFrame:
    p = s.panel
    sources = [
        p.filter("period >= 1996").select(*KEYS, "need"),
        p.filter("period <= 2000").select(*KEYS, "composite"),
        p.select(*KEYS, "wealth"),
        p.filter("flag_b = 0").select(*KEYS, "gov"),
        p.filter("tier IS NOT NULL").select(*KEYS, "tier"),
    ]
    merged = joins.merge_sources(p.select(*KEYS, "outcome"), sources, KEYS)
    return merged.select(
        *KEYS, *r6("outcome"), *r9("need", "composite"), *r4up("wealth"), *r9("gov"), "tier"
    )


@query("panel_rows", """
SELECT unit, unit_name, period, n_orders, round(outcome, 6) AS outcome, round(need, 9) AS need, round(composite, 9) AS composite,
       round(wealth + 1e-9, 4) AS wealth, round(gov, 9) AS gov, size, tier, region, flag_a, flag_b FROM panel""")
def panel_rows(s: Stages) -> DataFrame:
    return s.panel.select(
        "unit", "unit_name", "period", "n_orders", *r6("outcome"), *r9("need", "composite"), *r4up("wealth"), *r9("gov"), "size", "tier", "region", "flag_a", "flag_b",
    )


@query("join_fanout_guard", """
SELECT m.unit, m.period, q.n_orders FROM (SELECT unit, period FROM panel WHERE need IS NOT NULL) m
LEFT JOIN (SELECT unit, period, n_orders FROM panel WHERE tier IS NOT NULL) q ON q.unit = m.unit AND q.period = m.period""")
def join_fanout_guard(s: Stages) -> DataFrame:
    left = s.panel.filter("need IS NOT NULL").select(*KEYS)
    return joins.guarded_left_join(left, s.panel.filter("tier IS NOT NULL").select(*KEYS, "n_orders"), KEYS)


@query("join_attach_attributes", """
SELECT p.unit, p.period, u.profile, u.tier AS modal_tier FROM panel p LEFT JOIN units u ON u.unit = p.unit""", uses="units")
def join_attach_attributes(s: Stages) -> DataFrame:
    attributes = s.units.select("unit", "profile", F.col("tier").alias("modal_tier"))
    return s.panel.select(*KEYS).join(attributes, "unit", "left")


@query("join_semi", """
SELECT unit, period FROM panel WHERE unit IN (SELECT unit FROM panel GROUP BY unit HAVING count(DISTINCT period) >= 5)""")
def join_semi(s: Stages) -> DataFrame:
    return s.panel.select(*KEYS).join(enough_history(s.panel), "unit", "left_semi")


@query("join_membership_flag", """
SELECT c_custkey AS unit, CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS inland,
       CASE WHEN c_nationkey % 4 = 1 THEN 1 ELSE 0 END AS island FROM customer""", uses="")
def join_membership_flag(s: Stages) -> DataFrame:
    nations = s.table("nation").select(F.col("n_nationkey").alias("c_nationkey"))
    units = s.table("customer").select(F.col("c_custkey").alias("unit"), "c_nationkey")
    inland = joins.membership_flag(units, nations.filter("c_nationkey % 4 = 0"), "c_nationkey", "inland")
    return joins.membership_flag(inland, nations.filter("c_nationkey % 4 = 1"), "c_nationkey", "island").drop("c_nationkey")


# Every name in one of five spellings: as listed, upper case with a no-break space,
# one letter missing, unknown, or known only to the override list.
def _spellings(s: Stages) -> DataFrame:
    n, k = F.col("c_name"), F.col("c_custkey") % 5
    spelled = (
        F.when(k == 0, F.concat(F.upper(n), F.lit("\u00a0")))
        .when(k == 1, n)
        .when(k == 2, F.replace(n, F.lit("tom"), F.lit("tm")))
        .when(k == 3, F.concat(F.lit("Unlisted "), F.col("c_custkey").cast("string")))
        .otherwise(F.concat(F.lit("Formerly "), F.col("c_custkey").cast("string")))
    )
    return s.table("customer").select(spelled.alias("name"))


@query("join_name_resolution", """
WITH spelled AS (
  SELECT CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name WHEN 2 THEN replace(c_name, 'tom', 'tm')
         WHEN 3 THEN 'Unlisted ' || c_custkey ELSE 'Formerly ' || c_custkey END AS name FROM customer),
near AS (
  SELECT s.name, arg_min(c.c_custkey, (levenshtein(lower(s.name), lower(c.c_name)), lower(c.c_name))) AS code,
         min(levenshtein(lower(s.name), lower(c.c_name))) AS d
  FROM spelled s JOIN customer c ON abs(length(s.name) - length(c.c_name)) <= 1 AND levenshtein(lower(s.name), lower(c.c_name)) <= 1
  GROUP BY s.name)
FINAL SELECT s.name, CASE WHEN o.c_custkey IS NOT NULL THEN 'C' || o.c_custkey WHEN n.code IS NOT NULL THEN 'C' || n.code END AS code,
       CASE WHEN o.c_custkey IS NOT NULL THEN 'override' WHEN n.d = 0 THEN 'alias' WHEN n.d = 1 THEN 'nearest' END AS method
FROM spelled s LEFT JOIN near n ON n.name = s.name LEFT JOIN customer o ON s.name = 'Formerly ' || o.c_custkey""", uses="")
def join_name_resolution(s: Stages) -> DataFrame:
    code = F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code")
    customers = s.table("customer")
    aliases = customers.select(F.col("c_name").alias("name"), code)
    formerly = F.concat(F.lit("formerly "), F.col("c_custkey").cast("string")).alias("name")
    overrides = customers.filter("c_custkey % 5 = 4").select(formerly, code)
    return joins.resolve_names(_spellings(s), aliases, overrides)


@query("join_name_unmatched", "SELECT 'Unlisted ' || c_custkey AS name FROM customer WHERE c_custkey % 5 = 3", uses="")
def join_name_unmatched(s: Stages) -> DataFrame:
    aliases = s.table("customer").select(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("code"))
    formerly = F.concat(F.lit("formerly "), F.col("c_custkey").cast("string")).alias("name")
    overrides = s.table("customer").filter("c_custkey % 5 = 4").select(formerly, F.lit("x").alias("code"))
    return joins.unresolved(joins.resolve_names(_spellings(s), aliases, overrides))


@query("join_region_lookup", """
SELECT c.c_custkey AS unit, CASE WHEN c.c_custkey % 10 = 3 THEN 'ELSEWHERE' WHEN r.r_name <> 'AFRICA' THEN r.r_name END AS region
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""", uses="")
def join_region_lookup(s: Stages) -> DataFrame:
    units = s.table("customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("place"))
    overrides = units.filter("unit % 10 = 3").select("unit", F.lit("ELSEWHERE").alias("region"))
    lookup = (
        s.table("nation")
        .join(s.table("region").filter("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("place"), F.col("r_name").alias("region"))
    )
    return joins.lookup_with_override(units, "unit", "place", overrides, lookup, "region").select("unit", "region")


@query("join_aligned_diff", """
SELECT a.unit, a.n - b.n AS n
FROM (SELECT unit, count(*) AS n FROM panel GROUP BY unit) a JOIN (SELECT unit, count(*) AS n FROM complete GROUP BY unit) b ON b.unit = a.unit
WHERE a.n - b.n > 0""", uses="model")
def join_aligned_diff(s: Stages) -> DataFrame:
    from allocora.operators.reshape import complete_cases
    from allocora.plans.order_panel import INPUTS

    whole = s.panel.groupBy("unit").agg(F.count("*").alias("n"))
    kept = complete_cases(s.panel, ["outcome", *INPUTS]).groupBy("unit").agg(F.count("*").alias("n"))
    return joins.aligned_difference(whole, kept, "unit", "n").filter("n > 0")


@query("join_label_points", """
WITH lowest AS (SELECT unit, unit_name, score_mean FROM units WHERE NOT thin_data ORDER BY score_mean, unit LIMIT 20)
FINAL SELECT l.unit, l.unit_name AS short, CAST(c.c_nationkey * 7 % 90 AS DOUBLE) AS lat, CAST(c.c_nationkey * 13 % 180 AS DOUBLE) AS lon
FROM lowest l JOIN customer c ON c.c_custkey = l.unit WHERE c.c_nationkey <> 5""", uses="units")
def join_label_points(s: Stages) -> DataFrame:
    points = s.table("customer").filter("c_nationkey <> 5").select(
        F.col("c_custkey").alias("unit"),
        (F.col("c_nationkey") * 7 % 90).cast("double").alias("lat"),
        (F.col("c_nationkey") * 13 % 180).cast("double").alias("lon"),
    )
    from allocora.plans.reports import label_points

    return label_points(s.units, points, 20)


@query("set_difference", "SELECT DISTINCT unit FROM panel WHERE unit NOT IN (SELECT unit FROM scored)", uses="scored")
def set_difference(s: Stages) -> DataFrame:
    return sets.keys_missing_from(s.panel, s.scored, "unit")


@query("set_intersection", """
SELECT DISTINCT unit FROM panel WHERE tier = 'H' AND unit IN (SELECT unit FROM panel WHERE tier = 'L')""")
def set_intersection(s: Stages) -> DataFrame:
    return sets.keys_in_both(s.panel.filter("tier = 'H'"), s.panel.filter("tier = 'L'"), "unit")


@query("set_union_sources", """
SELECT unit, period, 'outcome' AS measure, round(outcome, 9) AS v FROM panel
UNION ALL SELECT unit, period, 'need', round(need, 9) FROM panel WHERE need IS NOT NULL""")
def set_union_sources(s: Stages) -> DataFrame:
    def measure(name: str) -> DataFrame:
        return s.panel.filter(F.col(name).isNotNull()).select(
            *KEYS, F.lit(name).alias("measure"), rnd(name, 9).alias("v")
        )

    return sets.stack([measure("outcome"), measure("need")])


@query("topk_extremes", """
SELECT 'lowest' AS side, * FROM (SELECT unit, unit_name, round(score_mean, 6) AS score_mean FROM units ORDER BY units.score_mean, unit LIMIT 5) a
UNION ALL
SELECT 'highest', * FROM (SELECT unit, unit_name, round(score_mean, 6) AS score_mean FROM units ORDER BY units.score_mean DESC, unit LIMIT 5) b""", uses="units")
def topk_extremes(s: Stages) -> DataFrame:
    def side(label: str, lowest: bool) -> DataFrame:
        rows = extremes(s.units, "score_mean", 5, lowest=lowest)
        return rows.select(F.lit(label).alias("side"), "unit", "unit_name", *r6("score_mean"))

    return sets.stack([side("lowest", True), side("highest", False)])
