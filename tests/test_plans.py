"""Shapes of physical plans that must hold at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import star
from checks.catalog import CHECKS
from tradewind.operators.skew import salted_join
from tradewind.operators.windows import latest_per_key, latest_rows
from tradewind.plans import reports
from tradewind.schemas import LATEST, PRODUCT_KEY, TABLES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, sf):
    return star.tables(spark, sf)


def test_platform_choice_prunes_fact_partitions(tables):
    ranked = {name: tables[name] for name in TABLES}
    text = plan(reports.sales_report(ranked, platform_id=12))
    scan = next(line for line in text.splitlines() if "fact_sales" in line)
    assert "platform_id" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "= 12" in scan


def test_kept_latest_rows_take_the_place_of_all_facts(tables):
    for report, fact in ((reports.sales_report, "fact_sales"), (reports.growth_report, "fact_periodic_sales")):
        text = plan(report(tables, platform_id=12))
        assert f"/{fact}" not in text and LATEST[fact][0] in text


def test_latest_rows_are_reduced_before_the_shuffle(tables):
    for df in (latest_rows(tables["fact_sales"], PRODUCT_KEY), latest_per_key(tables["fact_sales"], PRODUCT_KEY)):
        text = plan(df)
        assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning")
        assert "Partial" in text.split("Exchange hashpartitioning")[1]
        assert text.count("Exchange hashpartitioning") == 1


def test_reports_read_only_the_columns_they_need(tables):
    text = plan(reports.growth_report(tables, platform_id=12).select("category_name", "sold"))
    scans = [line for line in text.splitlines() if "FileScan" in line and "dim_product" in line]
    assert scans
    assert all("product_description" not in line for line in scans)


def test_keywords_become_substring_tests(tables):
    text = plan(reports.sales_report(tables, platform_id=12, keywords="ring, bolt"))
    assert "Contains(" in text
    assert "lambdafunction" not in text


@pytest.mark.parametrize(
    "name",
    [
        "growth_report_filtered",
        "best_seller_report_filtered",
        "top_categories_by_amount",
        "price_bands",
        "growth_per_period",
        "star_join",
        "older_against_latest",
        "adjusted_fact_delta",
        "products_p11",
    ],
)
def test_no_product_of_two_tables_and_no_python_rows(spark, sf, name):
    text = plan(CHECKS[name].run(spark, sf))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


def test_a_large_right_side_is_not_broadcast(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(salted_join(tables["fact_sales"].select("sale_id", "seller_id"), tables["dim_seller"], ["seller_id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_salt" in text
    assert "SortMergeJoin" in text


def test_top_k_does_not_sort_everything(tables):
    from tradewind.operators.rollups import top_categories

    text = plan(top_categories(reports.growth_report(tables, platform_id=12)))
    assert "TakeOrderedAndProject" in text


def test_price_bands_shuffle_groups_not_rows(tables):
    from tradewind.operators.rollups import price_bands

    report = reports.growth_report(tables, period="60-DAY")
    assert "partial_sum" in plan(price_bands(report))
    assert report.where(F.col("sold") <= 0).count() == 0
