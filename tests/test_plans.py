"""Plans of the core queries: pruned scans, pushed filters, no pair explosion."""

import pytest

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"
CORE = [
    "alpha_long", "alpha_no_group", "composition_all_ranks", "lump_top_n", "binned_curve", "interpolate_doy", "group_totals",
    "rank_diversity", "first_per_key", "mode_by", "survey_wide_table", "chemistry_daily_means", "merge_synonyms", "linear_fit",
]


def plan(spark, name):
    return queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_pair_explosion(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scan_is_pruned_and_filter_pushed(spark):
    text = plan(spark, "alpha_long")
    assert "GreaterThan(l_quantity,0.0)" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in text


def test_first_per_key_aggregates_before_the_shuffle(spark):
    text = plan(spark, "first_per_key")
    assert "Window" not in text and "partial_min_by" in text


def test_top_levels_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "composition_all_ranks")
