"""Rollups of report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions import to_long
from tradewind.operators.ranking import top_k

SALES = "sales"
REVENUE = "revenue"

# Price bands as label, lower bound; each ends where the next begins.
PRICE_BANDS = [
    ("< 10,000đ", 0),
    ("10,000 - 50,000đ", 10_000),
    ("50,000 - 100,000đ", 50_000),
    ("100,000 - 200,000đ", 100_000),
    ("200,000 - 500,000đ", 200_000),
    ("500,000 - 1,000,000đ", 500_000),
    ("1,000,000 - 3,000,000đ", 1_000_000),
    ("> 3,000,000đ", 3_000_000),
]

# How many entries each chart shows.
TOP_CATEGORIES = 20
TOP_SELLERS = 20
TOP_BRANDS = 15
TOP_LOCATIONS = 10


def measure(kind: str) -> Column:
    """Units for the sales view, otherwise the amount cut to a whole number after the sum."""
    return F.sum("sold").cast("bigint") if kind == SALES else to_long(F.sum("amount"))


def n_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def n_distinct(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias("n"))


def max_of(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.max(col).alias(f"max_{col}"))


def summary(report: DataFrame) -> DataFrame:
    """One row of totals; no report rows give a null date and zeros."""
    return report.agg(
        F.max("updated_date").alias("most_recent_date"),
        F.coalesce(F.sum("sold"), F.lit(0)).cast("bigint").alias("total_sold"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").alias("total_revenue"),
        F.count_distinct("product_code", "platform_id", "seller_id").alias("total_products"),
        F.count_distinct("seller_id").alias("total_sellers"),
    )


def _top(report: DataFrame, what: str, kind: str, k: int) -> DataFrame:
    grouped = report.groupBy(f"{what}_id", F.col(f"{what}_name").alias("name")).agg(measure(kind).alias("value"))
    return top_k(grouped, "value", k, ["name", f"{what}_id"]).select("name", "value")


def top_categories(report: DataFrame, kind: str = REVENUE, k: int = TOP_CATEGORIES) -> DataFrame:
    return _top(report, "category", kind, k)


def top_sellers(report: DataFrame, kind: str = REVENUE, k: int = TOP_SELLERS) -> DataFrame:
    return _top(report, "seller", kind, k)


def top_brands(report: DataFrame, kind: str = REVENUE, k: int = TOP_BRANDS) -> DataFrame:
    return _top(report, "brand", kind, k)


def top_locations(report: DataFrame, kind: str = REVENUE, k: int = TOP_LOCATIONS) -> DataFrame:
    return _top(report, "location", kind, k)


def by_platform(report: DataFrame, kind: str = REVENUE) -> DataFrame:
    grouped = report.groupBy("platform_id", F.col("platform_name").alias("name")).agg(measure(kind).alias("value"))
    return grouped.select("name", "value").orderBy("name")


def band_number(price: Column) -> Column:
    """Number of the price band, from 1; null below zero."""
    number = F.lit(None).cast("int")
    for position, (_, lower) in enumerate(PRICE_BANDS, start=1):
        number = F.when(price >= lower, F.lit(position)).otherwise(number)
    return number


def _band_label(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label, _ in PRICE_BANDS]), number)


def band_amounts(report: DataFrame) -> DataFrame:
    """Units and amount per price band and platform: at most bands times platforms rows."""
    banded = report.withColumn("band", band_number(F.col("product_price"))).where(F.col("band").isNotNull())
    return banded.groupBy("band", "platform_name").agg(
        F.sum("sold").cast("bigint").alias("sold"), to_long(F.sum("amount")).alias("amount")
    )


def price_bands(report: DataFrame) -> DataFrame:
    """Histogram over the price bands with a map of amounts per platform; empty bands are absent."""
    entry = F.struct("platform_name", "amount")
    return (
        band_amounts(report)
        .groupBy("band")
        .agg(
            F.sum("sold").alias("total_sold"),
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("platform_amounts"),
        )
        .select("band", _band_label(F.col("band")).alias("price_range"), "total_sold", "platform_amounts")
        .orderBy("band")
    )


def chart_visible(chart: DataFrame) -> DataFrame:
    return chart.agg((F.count_distinct("name") > 1).alias("visible"))


def platform_share(report: DataFrame, kind: str = REVENUE) -> DataFrame:
    """Percent of the total per platform, over the few platform rows only."""
    total = F.sum("value").over(Window.partitionBy())
    percent = F.col("value").cast("decimal(38,0)") * 100 / total.cast("decimal(38,0)")
    return by_platform(report, kind).select("name", "value", F.round(percent, 2).cast("decimal(5,2)").alias("percent"))


def _by_total(amounts: DataFrame) -> DataFrame:
    totals = amounts.groupBy("platform_name").agg(F.sum("amount").alias("total"))
    return totals.orderBy(F.col("total").desc(), "platform_name")


def platforms_by_total(report: DataFrame) -> DataFrame:
    """Platform names, the highest amount over all bands first."""
    return _by_total(band_amounts(report))


def band_pivot(report: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Amount per band with one column per platform, zero where missing.

    Without a given list the columns follow the platform totals. The report runs once: names and amounts both come
    from the sums per band and platform, a few rows.
    """
    amounts = band_amounts(report)
    if platforms is None:
        amounts = report.sparkSession.createDataFrame(amounts.collect(), amounts.schema)
        platforms = [row["platform_name"] for row in _by_total(amounts).collect()]
    wide = amounts.groupBy("band").pivot("platform_name", platforms).agg(F.sum("amount"))
    return wide.fillna(0, subset=platforms).select(
        "band", _band_label(F.col("band")).alias("price_range"), *platforms
    ).orderBy("band")


def product_cards(report: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Columns of a growth product card."""
    return report.select(
        "product_name",
        "product_image",
        "product_url",
        "product_price",
        "product_review_count",
        "product_all_time_sold",
        F.col("sold").alias("total_sold"),
        F.col("amount").alias("total_amount"),
        *carry,
    )


def best_seller_cards(report: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Columns of a best-seller card."""
    return report.select(
        "product_name",
        "product_image",
        "product_url",
        "product_price",
        "product_review_count",
        "product_rating_score",
        "category_name",
        "seller_name",
        "brand_name",
        "location_name",
        "total_sold",
        "total_amount",
        *carry,
    )
