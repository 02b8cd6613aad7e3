"""Projections from nested landing records to flat, typed rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import functions as X
from tradewind.operators.windows import first_per_key
from tradewind.schemas import P10, P11, P12, UNKNOWN_CODE, UNKNOWN_URL


def unnest(df: DataFrame, array: str, carry: dict[str, Column], name: str = "product") -> DataFrame:
    """One row per array element plus the carried columns; empty arrays give no row.

    From a bare column, Spark would infer a filter on its size, for which a computed array is computed once more.
    """
    elements = F.explode(F.when(F.size(array) > 0, F.col(array)))
    return df.select(elements.alias(name), *[c.alias(n) for n, c in carry.items()])


def project(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Nested paths, renames and constants in one projection."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def drop_null_keys(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=cols)


def dedupe(df: DataFrame, keys: list[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """One row per key. Without an order the remaining columns decide, so the survivor is fixed."""
    if order is None:
        order = [name for name in df.columns if name not in keys]
    if not order:
        return df.select(*keys).distinct()
    return first_per_key(df, keys, [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order])


def with_col(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def _coded_rows(df: DataFrame, code: str, columns: dict[str, Column]) -> DataFrame:
    rows = project(df, columns)
    return dedupe(drop_null_keys(rows, [code]), [code])


def brand_columns(platform_id: int) -> dict[str, Column]:
    """The brand that a record names. P11 expects the unnested `product` column."""
    code, name = {P11: ("product.brandId", "product.brandName"), P12: ("data.brand.id", "data.brand.name")}[
        platform_id
    ]
    return {
        "brand_code": X.to_type(F.trim(F.col(code).cast("string")), "bigint"),
        "brand_name": F.trim(name),
        "platform_id": X.typed_lit(platform_id, "int"),
    }


def brand_rows(df: DataFrame, platform_id: int) -> DataFrame:
    """Brands of one marketplace, one row per code."""
    return _coded_rows(df, "brand_code", brand_columns(platform_id))


def seller_columns(platform_id: int) -> dict[str, Column]:
    """The seller that a record names; P11 has no seller url."""
    code, name, url = {
        P11: ("product.sellerId", "product.sellerName", None),
        P12: ("data.current_seller.id", "data.current_seller.name", "data.current_seller.link"),
    }[platform_id]
    return {
        "seller_code": X.to_type(F.trim(F.col(code).cast("string")), "bigint"),
        "seller_name": F.trim(name),
        "seller_url": F.trim(url) if url else X.typed_lit(None, "string"),
        "platform_id": X.typed_lit(platform_id, "int"),
    }


def seller_rows(df: DataFrame, platform_id: int) -> DataFrame:
    """Sellers of one marketplace, one row per code."""
    return _coded_rows(df, "seller_code", seller_columns(platform_id))


def location_name(c: Column, platform_id: int) -> Column:
    """Place name in upper case; only P10 text carries list marks."""
    trimmed = F.trim(c)
    return F.upper(X.clean_location(trimmed) if platform_id == P10 else trimmed)


def location_columns(platform_id: int) -> dict[str, Column]:
    text = F.col("location") if platform_id == P10 else F.col("product.location")
    return {"location_name": location_name(text, platform_id)}


def location_rows(df: DataFrame, platform_id: int) -> DataFrame:
    return drop_null_keys(project(df, location_columns(platform_id)), ["location_name"]).distinct()


def category_rows_nested(df: DataFrame, platform_id: int = P10) -> DataFrame:
    """Category arrays to rows: level 0 under the root parent -1, else level 1; one row per code."""
    rows = df.select(F.explode("category").alias("category")).select(
        X.to_type(F.col("category.category_id"), "bigint").alias("category_code"),
        X.typed_lit(platform_id, "int").alias("platform_id"),
        F.col("category.category_name").alias("category_name"),
        F.lit(UNKNOWN_URL).alias("category_url"),
        X.to_type(F.col("category.parent_id"), "bigint").alias("parent_code"),
        F.when(F.col("category.parent_id") == str(UNKNOWN_CODE), 0).otherwise(1).alias("level"),
    )
    return dedupe(drop_null_keys(rows, ["category_code"]), ["category_code"])


def _version_columns(as_of: dt.date | str) -> dict[str, Column]:
    return {
        "effective_date": X.typed_lit(str(as_of), "date"),
        "expired_date": X.typed_lit(None, "date"),
        "flag": F.lit(True),
    }


def _product_rows(df: DataFrame, columns: dict[str, Column], as_of: dt.date | str, single: bool) -> DataFrame:
    """Product rows, of each product and seller code one, or with `single` off all that are there."""
    rows = drop_null_keys(project(df, {**columns, **_version_columns(as_of)}), ["product_code"])
    return dedupe(rows, ["product_code", "platform_id", "seller_code"]) if single else rows


def product_rows_p12(df: DataFrame, as_of: dt.date | str, single: bool = True) -> DataFrame:
    return _product_rows(
        df,
        {
            "product_code": F.col("product_id"),
            "product_name": F.col("data.name"),
            "product_description": F.col("data.short_description"),
            "product_image": F.col("data.thumbnail_url"),
            "product_url": F.col("data.short_url"),
            "price": X.money(F.col("data.price")),
            "original_price": X.money(F.col("data.original_price")),
            "discount_rate": X.percent_rate(F.col("data.discount_rate")),
            "rating_score": X.rate(F.col("data.rating_average")),
            "review_count": X.count_or(F.col("data.review_count"), 0, "int"),
            "seller_code": X.count_or(F.col("data.current_seller.id"), UNKNOWN_CODE),
            "platform_id": X.typed_lit(P12, "int"),
            "sold": X.count_or(F.col("data.all_time_quantity_sold"), 0),
        },
        as_of,
        single,
    )


def product_rows_p11(df: DataFrame, as_of: dt.date | str, single: bool = True) -> DataFrame:
    def text(name: str) -> Column:
        return F.trim(F.col(f"product.{name}"))

    return _product_rows(
        df,
        {
            "product_code": text("itemId"),
            "product_name": text("name"),
            "product_description": text("name"),
            "product_image": text("image"),
            "product_url": text("itemUrl"),
            "price": X.money(text("price")),
            "original_price": X.money(text("originalPrice")),
            "discount_rate": X.rate(X.discount_rate(text("discount"))),
            "rating_score": X.rate(text("ratingScore")),
            "review_count": X.count_or(text("review"), 0, "int"),
            "seller_code": X.count_or(text("sellerId"), UNKNOWN_CODE),
            "platform_id": X.typed_lit(P11, "int"),
            "sold": X.count_or(X.sold_count(text("itemSoldCntShow")), 0),
        },
        as_of,
        single,
    )


def product_rows_p10(df: DataFrame, as_of: dt.date | str, single: bool = True) -> DataFrame:
    """P10 names no seller, so every product belongs to the unknown one."""
    return _product_rows(
        df,
        {
            "product_code": X.product_id_from_url(F.col("url")),
            "product_name": F.col("title"),
            "product_description": F.col("title"),
            "product_image": F.col("image"),
            "product_url": F.col("url"),
            "price": X.money(X.clean_price(F.col("price.current_price"), ".")),
            "original_price": X.money(X.clean_price(F.col("price.original_price"), "₫.")),
            "discount_rate": X.percent_rate(X.clean_price(F.col("price.discount_rate"), "-%")),
            "rating_score": X.typed_lit("0.00", "decimal(5,2)"),
            "review_count": X.typed_lit(0, "int"),
            "seller_code": X.typed_lit(UNKNOWN_CODE, "bigint"),
            "platform_id": X.typed_lit(P10, "int"),
            "sold": X.count_or(X.sold_count(F.trim("sold")), 0),
        },
        as_of,
        single,
    )


PRODUCT_ROWS = {P10: product_rows_p10, P11: product_rows_p11, P12: product_rows_p12}


def flat_listing(df: DataFrame, platform_id: int) -> DataFrame:
    """Landing records with one product per row; only P11 nests products in a page record."""
    if platform_id != P11:
        return df
    category = X.to_type(F.trim("main_info.trackParams.category"), "bigint")
    return unnest(df, "products", {"category_id": category, "platform_id": X.typed_lit(P11, "int")})
