"""Published figures, recomputed from published result tables.

Set PANEL_GOLDEN_DIR to a folder with the tables as CSV files; they are told apart
by their header. Without it these tests are skipped.
"""

import csv
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.functions.labels import direction, gap_status
from allocora.functions.tails import trend_p_value
from allocora.operators import rank_tests
from allocora.operators.concentration import concentration_facts, gini
from allocora.operators.ranking import extremes, quartile_edges, quartile_profile, tier_ranks
from allocora.operators.trend import project_log
from allocora.plans import reports

FOLDER = os.environ.get("PANEL_GOLDEN_DIR")
pytestmark = pytest.mark.skipif(not FOLDER, reason="PANEL_GOLDEN_DIR is not set")


def table(spark, marker):
    for path in sorted(Path(FOLDER).glob("*.csv")):
        with open(path, encoding="utf-8-sig") as f:
            if marker in next(csv.reader(f)):
                return spark.read.csv(str(path), header=True, inferSchema=True)
    pytest.skip(f"no table with column {marker}")


@pytest.fixture(scope="module")
def units(spark):
    df = table(spark, "tier_pct").withColumnsRenamed(
        {"iso3": "unit", "country": "unit_name", "misallocation_mean": "score_mean", "aid_usd_m_mean": "outcome_mean",
         "income_tier": "tier", "income_tier_recent": "tier_recent"}
    )
    return df.cache()


@pytest.fixture(scope="module")
def projection(spark):
    return table(spark, "trend_r2").withColumnsRenamed({"iso3": "unit", "country": "unit_name", "trend_r2": "r2", "trend_p": "p"}).cache()


def test_size_and_concentration(units):
    assert units.count() == 138 and units.agg(F.sum("n_years")).first()[0] == 1806
    assert gini(units, "outcome_mean").first().gini == pytest.approx(0.618672, abs=5e-7)
    facts = concentration_facts(units, "outcome_mean").first()
    assert facts.top_share == pytest.approx(0.438946, abs=5e-7)
    assert facts.bottom_half_share == pytest.approx(0.076934, abs=5e-7)
    assert facts.top_half_share == pytest.approx(0.130435, abs=5e-7)


def test_extremes(units):
    low = [round(r.score_mean, 2) for r in extremes(units, "score_mean", 5).collect()]
    high = [round(r.score_mean, 2) for r in extremes(units, "score_mean", 5, lowest=False).collect()]
    assert low == [-2.30, -2.28, -1.98, -1.80, -1.76]
    assert high == [1.83, 1.77, 1.73, 1.68, 1.62]


def test_ranks_and_profiles(units):
    plain = units.select("unit", "tier", "score_mean", *[F.col(c).alias(f"g_{c}") for c in ("tier_rank", "tier_n", "tier_pct", "profile")])
    found = quartile_profile(tier_ranks(plain, "score_mean", "tier"), "score_mean")
    for c in ("tier_rank", "tier_n", "tier_pct", "profile"):
        assert found.filter(F.col(c) != F.col(f"g_{c}")).isEmpty(), c
    edges = quartile_edges(units, "score_mean")
    assert (edges.q1, edges.q2, edges.q3) == pytest.approx((-0.644872, 0.022774, 0.558170), abs=5e-7)
    sizes = {r.profile: r["count"] for r in found.groupBy("profile").count().collect()}
    assert [sizes[p] for p in fixed.PROFILES] == [35, 34, 34, 35]


def test_tiers_and_thin(units):
    sizes = {r.tier: r["count"] for r in units.groupBy("tier").count().collect()}
    assert [sizes[t] for t in fixed.TIER_ORDER] == [27, 49, 54, 8]
    assert units.filter("tier <> tier_recent").count() == 21
    assert units.filter(F.col("n_years") < fixed.THIN_PERIODS).count() == 5


def test_region_means(units):
    gaps = reports.region_gap(units).select("region", "region_mean").distinct().collect()
    means = {r.region: round(r.region_mean, 4) for r in gaps}
    assert means["Sub-Saharan Africa"] == -0.2959 and means["South Asia"] == -0.2243
    assert sum(m < 0 for m in means.values()) == 2


def test_projection_values(projection):
    assert projection.count() == 134
    ours = project_log(projection.withColumnsRenamed(
        {"annual_pct": "g_annual", "trend_significant": "g_sig", "direction": "g_dir"}), 2023, 2030)
    worst = ours.agg(
        F.max(F.abs(F.col("fit_base") - F.col("aid_2023_fit_usd_m"))), F.max(F.abs(F.col("fit_horizon") - F.col("aid_2030_proj_usd_m"))),
        F.max(F.abs(F.col("annual_pct") - F.col("g_annual"))),
    ).first()
    assert max(worst) < 1e-9
    assert ours.filter((F.col("direction") != F.col("g_dir")) | (F.col("trend_significant") != F.col("g_sig"))).isEmpty()
    counts = {r.direction: r["count"] for r in ours.groupBy(direction("annual_pct").alias("direction")).count().collect()}
    assert counts == {"Rising": 116, "Falling": 13, "Flat": 5}
    assert ours.filter("trend_significant").count() == 71


def test_trend_p_values(projection):
    rows = projection.withColumn("ours", trend_p_value(F.col("r2"), F.col("n_years").cast("bigint")))
    assert rows.agg(F.max(F.abs(F.col("ours") - F.col("p")))).first()[0] < 1e-9


def test_growth(projection):
    growth = reports.growth_by_profile(projection).filter("trends = 'all'").collect()
    medians = {r.profile: round(r.median, 2) for r in growth}
    assert [medians[p] for p in fixed.PROFILES] == [11.53, 16.03, 12.01, 12.31]


def test_rank_tests(projection):
    whole = rank_tests.kruskal(projection, "annual_pct", "profile", fixed.PROFILES)
    some = rank_tests.kruskal(projection.filter("trend_significant"), "annual_pct", "profile", fixed.PROFILES)
    assert (whole["h"], whole["p"]) == pytest.approx((0.6437, 0.886), abs=5e-4)
    assert (some["h"], some["p"]) == pytest.approx((10.5674, 0.014), abs=5e-4)
    pair = rank_tests.mann_whitney(projection, "annual_pct", "profile", fixed.PROFILES[0], fixed.PROFILES[3])
    assert pair["u"] == 554 and pair["p"] == pytest.approx(0.627, abs=5e-4)


def test_regional_status(spark):
    df = table(spark, "gap_2030").withColumnsRenamed({"gap_2023": "gap_base", "gap_2030": "gap_horizon"})
    assert df.filter(gap_status("gap_base", "slope") != F.col("status")).isEmpty()
    cards = reports.regional_cards(df).first()
    assert (cards.n_closing, cards.n_widening) == (2, 4)
