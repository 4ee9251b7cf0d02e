"""Shapes of the physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.topk import top_k

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_cuts_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    text = plan(top_k(df, ["g"], [F.desc("id")], 5))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


@pytest.mark.parametrize("name", ["ic_by_config_horizon", "episodes", "lexical_search", "walk_forward_rules", "full_context", "score_stats"])
def test_no_cross_products(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns_and_gets_the_filter(spark):
    text = plan(entry.queries()["price_range"](spark, SF_DIR))
    assert "l_comment" not in text and "l_tax" not in text
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#7)" in text


def test_listing_uses_top_k_operator(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["ledger_list"](spark, SF_DIR))
