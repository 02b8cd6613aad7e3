"""Growth and best-seller reports."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import period_start
from tradewind.functions.calendar import OFFERED_PERIODS
from tradewind.operators import rollups as R
from tradewind.operators.filters import (
    in_subtree,
    keyword_match,
    normalize_params,
    period_match,
    positive,
    root_categories,
    where_opt,
)
from tradewind.operators.joins import star
from tradewind.operators.ranking import page_info, page_rows
from tradewind.operators.trees import subtree
from tradewind.operators.windows import latest_rows, longest_period
from tradewind.plans.warehouse import staging
from tradewind.schemas import LATEST, PRODUCT_KEY
from tradewind.sources.tables import rows_to_df

KEYWORD_COLUMNS = ["category_name", "product_name", "product_description"]
BEST_BY_SOLD = "sold"


def _in_category(
    facts: DataFrame, tables: Mapping[str, DataFrame], platform_id: int | None, category_id: int | None
) -> DataFrame:
    if category_id is None:
        return facts
    return in_subtree(facts, subtree(tables["dim_category"], platform_id, category_id))


def latest_of(tables: Mapping[str, DataFrame], fact: str, platform_id: int | None) -> DataFrame:
    """Rows of the latest date of each product: as the loads have kept them, else ranked from all facts."""
    kept = LATEST[fact][0]
    if kept in tables:
        return where_opt(tables[kept], "platform_id", platform_id)
    return latest_rows(where_opt(tables[fact], "platform_id", platform_id), PRODUCT_KEY)


def growth_report(
    tables: Mapping[str, DataFrame],
    platform_id: int | None = None,
    category_id: int | None = None,
    period: str = "30-DAY",
    keywords: str | None = None,
) -> DataFrame:
    """Growth rows of the latest date of each product, in the longest period that the choice accepts."""
    latest = latest_of(tables, "fact_periodic_sales", platform_id)
    recent = positive(latest, ["units_sold", "total_sales_amount"])
    chosen = longest_period(period_match(recent, period), PRODUCT_KEY)
    wide = star(_in_category(chosen, tables, platform_id, category_id), tables, latest, single=True)
    return keyword_match(wide, keywords, KEYWORD_COLUMNS).select(
        F.col("snapshot_id").alias("id"),
        "date_id",
        F.col("date").alias("updated_date"),
        "platform_id",
        "platform_name",
        "category_id",
        "category_name",
        "seller_id",
        "seller_name",
        "product_code",
        "product_name",
        "product_image",
        "product_url",
        F.col("price").alias("product_price"),
        F.col("review_count").alias("product_review_count"),
        F.col("sold").alias("product_all_time_sold"),
        "brand_id",
        "brand_name",
        "location_id",
        "location_name",
        F.col("units_sold").alias("sold"),
        F.col("total_sales_amount").alias("amount"),
        F.col("report_period").alias("period"),
    )


def sales_report(
    tables: Mapping[str, DataFrame],
    platform_id: int | None = None,
    category_id: int | None = None,
    keywords: str | None = None,
) -> DataFrame:
    """Latest sales snapshot of each product."""
    latest = latest_of(tables, "fact_sales", platform_id)
    recent = positive(latest, ["units_sold", "total_sales_amount"])
    wide = star(_in_category(recent, tables, platform_id, category_id), tables, latest, single=True)
    return keyword_match(wide, keywords, KEYWORD_COLUMNS).select(
        F.col("sale_id").alias("id"),
        "date_id",
        F.col("date").alias("updated_date"),
        "platform_id",
        "platform_name",
        "category_id",
        "category_name",
        "seller_id",
        "seller_name",
        "product_code",
        "product_name",
        "product_image",
        "product_url",
        F.col("price").alias("product_price"),
        F.col("review_count").alias("product_review_count"),
        F.col("rating_score").alias("product_rating_score"),
        "brand_id",
        "brand_name",
        "location_id",
        "location_name",
        F.col("units_sold").alias("total_sold"),
        F.col("total_sales_amount").alias("total_amount"),
    )


PAGE_COLUMNS = ["current_page", "page_size", "total_page"]


def _page(report: DataFrame, measure: str, page: int) -> DataFrame:
    """The rows of one page with its number and the page count; the report runs once, into a staged copy.

    The copy gives the count, which its files hold, and the page, a bounded number of rows.
    """
    with staging(report.sparkSession) as stage:
        rows = page_rows(stage(report, "page"), measure, ["id"], page)
        return report.sparkSession.createDataFrame(rows.collect(), rows.schema)


def growth_page(report: DataFrame, kind: str = R.REVENUE, page: int = 1) -> DataFrame:
    """Product cards of one page, by units or by amount, highest first; none for an empty report."""
    rows = _page(report, "sold" if kind == R.SALES else "amount", page)
    return R.product_cards(rows, PAGE_COLUMNS)


def best_seller_page(report: DataFrame, order_by: str = BEST_BY_SOLD, page: int = 1) -> DataFrame:
    """Best-seller cards of one page; none for an empty report."""
    rows = _page(report, "total_sold" if order_by == BEST_BY_SOLD else "total_amount", page)
    return R.best_seller_cards(rows, PAGE_COLUMNS)


def best_sellers(tables: Mapping[str, DataFrame], params: Mapping[str, Any], page: int = 1) -> DataFrame | None:
    """Best-seller page for request parameters; None unless platform and order are chosen."""
    chosen = normalize_params(params)
    if chosen.get("platform_id") is None or chosen.get("order_by") is None:
        return None
    report = sales_report(tables, chosen["platform_id"], chosen.get("category_id"), chosen.get("keywords"))
    return best_seller_page(report, chosen["order_by"], page)


def report_dates(report: DataFrame, period: str) -> DataFrame:
    """First and last day that the summary covers."""
    return R.max_of(report, "updated_date").select(
        period_start(F.col("max_updated_date"), F.lit(period)).alias("from_date"),
        F.col("max_updated_date").alias("to_date"),
    )


def analysis(
    tables: Mapping[str, DataFrame], params: Mapping[str, Any], kind: str = R.REVENUE, page: int = 1
) -> dict[str, DataFrame]:
    """All frames of the analysis view for request parameters.

    The report is persisted because each rollup reads it once; release it with
    `result["report"].unpersist()`. Without a platform there is one chart over the platforms, with
    one there are the category, seller, brand and location charts and the product page.
    """
    chosen = normalize_params(params)
    period = chosen.get("period") or OFFERED_PERIODS[0]
    report = growth_report(
        tables, chosen.get("platform_id"), chosen.get("category_id"), period, chosen.get("keywords")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    frames = {
        "report": report,
        "summary": R.summary(report),
        "dates": report_dates(report, period),
        "price_bands": R.price_bands(report),
    }
    if chosen.get("platform_id") is None:
        return {**frames, "platforms": R.by_platform(report, kind), "platform_share": R.platform_share(report, kind)}
    return {
        **frames,
        "categories": R.top_categories(report, kind),
        "sellers": R.top_sellers(report, kind),
        "brands": R.top_brands(report, kind),
        "locations": R.top_locations(report, kind),
        "page_info": page_info(report, page),
        "products": growth_page(report, kind, page),
    }


def filter_options(tables: Mapping[str, DataFrame], platform_id: int) -> dict[str, DataFrame]:
    """What a user may choose from: platforms, root categories, periods."""
    platforms = tables["dim_platform"].orderBy("platform_id")
    spark = platforms.sparkSession
    return {
        "platforms": platforms,
        "categories": root_categories(tables["dim_category"], platform_id),
        "periods": rows_to_df(spark, [(p,) for p in OFFERED_PERIODS], "period string"),
    }
