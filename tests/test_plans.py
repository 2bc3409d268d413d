"""Shape of the physical plans: what is shuffled, pruned and kept off a single task."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from allocora.operators import ranking
from allocora.operators.ordered import order_by_value
from allocora.plans.order_panel import order_panel
from workload.registry import Stages

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    return Stages.of(spark, SF_DIR)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_reads_only_what_it_uses(spark):
    text = plan(order_panel(spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lines = next(s for s in schemas if "l_orderkey" in s)
    assert "l_shipdate" not in lines and "l_partkey" not in lines
    assert len(re.findall(r"Exchange hashpartitioning\(unit", text)) == 2


@pytest.mark.parametrize("name", ["agg_modal_tier", "trend_unit_fit", "win_bfill_ffill", "agg_unit_scores", "report_trajectory", "trend_abs_gap", "join_semi"])
def test_unit_work_needs_no_shuffle(spark, name):
    text = plan(entry_module.queries()[name](spark, SF_DIR))
    assert "Exchange" not in text.replace("BroadcastExchange", "")


def test_filters_reach_the_scan(spark):
    text = plan(entry_module.queries()["filter_range"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(period), IsNotNull(outcome), GreaterThanOrEqual(period,1997)" in text


def test_top_k_is_local_first(stages):
    assert "TakeOrderedAndProject" in plan(ranking.extremes(stages.units, "score_mean", 5))
    text = plan(ranking.top_per_group(stages.units, "tier", "score_mean", 3))
    assert text.count("WindowGroupLimit") >= 2


def window_keys(text):
    """Columns summed and partition keys of every window in a plan."""
    return re.findall(r"Window \[(.*?)\], \[([^\[\]]*)\], \[", text)


def test_ranks_have_no_window_over_a_group(stages):
    found = window_keys(plan(order_by_value(stages.units, "score_mean", ["tier"])))
    assert found
    for summed, keys in found:
        # Counted rows per range, or the totals of the ranges.
        assert "_range" in keys or "_in_" in summed


@pytest.mark.parametrize("name", ["win_relative_position", "conc_gini", "conc_lorenz", "agg_spearman", "agg_describe"])
def test_only_range_totals_meet_in_one_window(spark, name):
    text = plan(entry_module.queries()[name](spark, SF_DIR))
    for window in re.findall(r"Window \[[^\n]*", text):
        assert "_in_" in window or re.search(r"\], \[[^\]]*_range#\d+", window)


def test_session_names_the_shared_folder(spark):
    from allocora.runtime import shared_dir

    assert shared_dir(spark) == shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_panel_key_is_unique(stages):
    assert stages.panel.groupBy("unit", "period").count().filter("count > 1").isEmpty()
    assert stages.scored.agg(F.abs(F.sum("score")) < 1e-6).first()[0]
