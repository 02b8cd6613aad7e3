"""Landing records of the three marketplaces, derived from the test tables, with their oracles.

Some fields are left out or damaged by part size, so that defaults and cleaning rules have work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks import star
from tradewind.schemas import LANDING

NO_CATEGORY, NO_BRAND, NO_SELLER, NO_PRICE = 48, 2, 3, 1


def _url() -> Column:
    return F.concat(
        F.lit("https://shop.example.com/"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
        F.lit("-i."),
        F.col("s_suppkey"),
        F.lit("."),
        F.col("p_partkey"),
        F.lit("?sp=1"),
    )


def sold_text(units: Column) -> Column:
    """Counter text: '12 sold', '3k', '1.2k sold', or nothing for a few."""
    plain = F.concat(units.cast("string"), F.lit(" sold"))
    tenths = F.concat((units / 10).cast("int").cast("string"), F.lit("."), (units % 10).cast("string"), F.lit("k sold"))
    return (
        F.when(units >= 30, tenths)
        .when(units >= 20, F.concat(units.cast("string"), F.lit("K")))
        .when(units < 3, F.lit(""))
        .otherwise(plain)
    )


SOLD_SQL = """CASE WHEN units >= 30 THEN units * 100 WHEN units >= 20 THEN units * 1000 WHEN units < 3 THEN 0
              ELSE units END"""


def snapshot(spark: SparkSession, sf: str, platform_id: int, date_id: int) -> DataFrame:
    rows = star.stored(spark, sf, "sold_pairs").where(F.col("platform_id") == platform_id)
    day = dict(star.CUTOFFS)[date_id]
    return rows.where(star.listed(date_id, day)).withColumn("units", F.col(f"u{date_id}"))


def landing_p12(spark: SparkSession, sf: str, date_id: int) -> DataFrame:
    size = F.col("p_size")
    brand = F.struct(F.col("brand_code").alias("id"), F.col("p_brand").alias("name"))
    seller = F.struct(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://seller.example.com/"), F.col("s_suppkey")).alias("link"),
    )
    data = F.struct(
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_type", "p_brand").alias("short_description"),
        F.concat(F.lit("https://img.example.com/"), F.col("p_partkey"), F.lit(".jpg")).alias("thumbnail_url"),
        _url().alias("short_url"),
        F.when(size != NO_PRICE, F.col("price").cast("double")).alias("price"),
        F.col("original_price").cast("double").alias("original_price"),
        size.cast("double").alias("discount_rate"),
        F.when(size != NO_PRICE, (size % 6).cast("double")).alias("rating_average"),
        (size * 10).cast("bigint").alias("review_count"),
        F.col("units").alias("all_time_quantity_sold"),
        F.when(size != NO_BRAND, brand).alias("brand"),
        F.when(size != NO_SELLER, seller).alias("current_seller"),
    )
    return snapshot(spark, sf, 12, date_id).select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.when(size <= NO_CATEGORY, F.col("c3").cast("string")).otherwise("").alias("category_id"),
        F.lit("1720000000.5").alias("timestamp"),
        data.alias("data"),
    )


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c.cast("string"), F.lit(" "))


def landing_p11(spark: SparkSession, sf: str, date_id: int) -> DataFrame:
    """One page per product with two items: the product and a second one at the original price."""
    size = F.col("p_size")

    def item(code: Column, price: str) -> Column:
        return F.struct(
            _padded(code).alias("itemId"),
            _padded(F.col("p_name")).alias("name"),
            F.concat(F.lit("https://img.example.com/"), F.col("p_partkey"), F.lit(".jpg")).alias("image"),
            _url().alias("itemUrl"),
            F.when(size == NO_PRICE, "free").otherwise(_padded(F.col(price))).alias("price"),
            _padded(F.col("original_price")).alias("originalPrice"),
            F.when(size > 45, "")
            .when(size == 44, "half")
            .otherwise(F.concat(size.cast("string"), F.lit("% Off")))
            .alias("discount"),
            F.when(size != NO_PRICE, (size % 6).cast("string")).alias("ratingScore"),
            _padded(size * 10).alias("review"),
            F.when(size != NO_SELLER, _padded(F.col("s_suppkey"))).otherwise("").alias("sellerId"),
            _padded(F.col("s_name")).alias("sellerName"),
            F.when(size != NO_BRAND, _padded(F.col("brand_code"))).otherwise("").alias("brandId"),
            _padded(F.col("p_brand")).alias("brandName"),
            F.concat(F.lit(" "), F.lower("n_name")).alias("location"),
            sold_text(F.col("units")).alias("itemSoldCntShow"),
        )

    code = F.col("p_partkey").cast("string")
    items = F.array(item(code, "price"), item(F.concat(F.lit("v"), code), "original_price"))
    category = F.when(size <= NO_CATEGORY, _padded(F.col("c3"))).otherwise("none")
    main = F.struct(
        F.struct(category.alias("category")).alias("trackParams"),
        F.lit("2").alias("totalResults"),
        F.lit("40").alias("pageSize"),
    )
    return snapshot(spark, sf, 11, date_id).select(
        items.alias("products"),
        main.alias("main_info"),
        F.lit("{}").alias("seo_info"),
        F.lit(1720000000.5).alias("timestamp"),
    )


def _dotted(c: Column) -> Column:
    return F.replace(F.format_number(F.floor(c).cast("bigint"), 0), F.lit(","), F.lit("."))


def landing_p10(spark: SparkSession, sf: str, date_id: int) -> DataFrame:
    size = F.col("p_size")

    def level(code: Column, name: Column, parent: Column) -> Column:
        return F.struct(code.alias("category_id"), name.alias("category_name"), parent.alias("parent_id"))

    second = F.when(size <= NO_CATEGORY, F.col("c1").cast("string")).otherwise("")
    category = F.array(
        level(F.col("c0").cast("string"), F.col("p_type"), F.lit("-1")),
        level(second, F.concat_ws(" ", "p_type", (size % 5).cast("string")), F.col("c0").cast("string")),
    )
    price = F.struct(
        F.when(size == NO_PRICE, "10.000 - 20.000").otherwise(_dotted(F.col("price"))).alias("current_price"),
        F.concat(F.lit("₫"), _dotted(F.col("original_price"))).alias("original_price"),
        F.when(size > 45, "").otherwise(F.concat(F.lit("-"), size.cast("string"), F.lit("%"))).alias("discount_rate"),
    )
    place = F.when(size > 25, F.concat(F.lit("TP. "), F.lower("n_name"))).otherwise(
        F.concat(F.lit("|"), F.lower("n_name"))
    )
    return snapshot(spark, sf, 10, date_id).select(
        category.alias("category"),
        F.when(size == 7, F.replace(_url(), F.lit("?sp=1"), F.lit(""))).otherwise(_url()).alias("url"),
        F.concat(F.lit("https://img.example.com/"), F.col("p_partkey"), F.lit(".jpg")).alias("image"),
        F.col("p_name").alias("title"),
        F.array(F.lit("sale")).alias("promotions"),
        price.alias("price"),
        sold_text(F.col("units")).alias("sold"),
        place.alias("location"),
    )


BUILDERS = {10: landing_p10, 11: landing_p11, 12: landing_p12}


def landing(spark: SparkSession, sf: str, platform_id: int, date_id: int) -> DataFrame:
    """Landing records with the declared types; a column that has its type is not cast, so that fields nobody reads can go."""
    rows = BUILDERS[platform_id](spark, sf, date_id)
    declared = StructType.fromDDL(LANDING[platform_id])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(
        *[F.col(f.name) if kinds[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields]
    )


def _versions(date_id: int) -> str:
    return f"DATE '{dict(star.CUTOFFS)[date_id]}' AS effective_date, NULL::DATE AS expired_date, true AS flag"


def image_sql(platform_id: int, date_id: int) -> str:
    """Product rows that the cleaning of a snapshot must give, by seller code."""
    if platform_id == 12:
        body = f"""SELECT p_partkey::VARCHAR AS product_code, p_name AS product_name,
          p_type || ' ' || p_brand AS product_description,
          'https://img.example.com/' || p_partkey || '.jpg' AS product_image, product_url,
          CASE WHEN p_size = {NO_PRICE} THEN 0 ELSE price END::DECIMAL(15,2) AS price, original_price,
          (p_size * 0.01::DECIMAL(5,2))::DECIMAL(5,2) AS discount_rate,
          CASE WHEN p_size = {NO_PRICE} THEN 0 ELSE p_size % 6 END::DECIMAL(5,2) AS rating_score,
          (p_size * 10)::INT AS review_count, CASE WHEN p_size = {NO_SELLER} THEN -1 ELSE s_suppkey END AS seller_code,
          12 AS platform_id, units AS sold, {_versions(date_id)}
        FROM listing WHERE platform_id = 12 AND date_id = {date_id}"""
    elif platform_id == 11:
        body = f"""SELECT v.prefix || p_partkey AS product_code, p_name AS product_name, p_name AS product_description,
          'https://img.example.com/' || p_partkey || '.jpg' AS product_image, product_url,
          CASE WHEN p_size = {NO_PRICE} THEN 0 WHEN v.prefix = 'v' THEN original_price ELSE price END::DECIMAL(15,2)
            AS price,
          original_price,
          CASE WHEN p_size >= 44 AND p_size <> 45 THEN 0 ELSE p_size * 0.01::DECIMAL(5,2) END::DECIMAL(5,2)
            AS discount_rate,
          CASE WHEN p_size = {NO_PRICE} THEN 0 ELSE p_size % 6 END::DECIMAL(5,2) AS rating_score,
          (p_size * 10)::INT AS review_count, CASE WHEN p_size = {NO_SELLER} THEN -1 ELSE s_suppkey END AS seller_code,
          11 AS platform_id, ({SOLD_SQL})::BIGINT AS sold, {_versions(date_id)}
        FROM listing, (VALUES (''), ('v')) v(prefix) WHERE platform_id = 11 AND date_id = {date_id}"""
    else:
        body = f"""SELECT p_partkey::VARCHAR AS product_code, p_name AS product_name, p_name AS product_description,
          'https://img.example.com/' || p_partkey || '.jpg' AS product_image, product_url,
          CASE WHEN p_size = {NO_PRICE} THEN 0 ELSE floor(price) END::DECIMAL(15,2) AS price,
          floor(original_price)::DECIMAL(15,2) AS original_price,
          CASE WHEN p_size > 45 THEN 0 ELSE p_size * 0.01::DECIMAL(5,2) END::DECIMAL(5,2) AS discount_rate,
          0::DECIMAL(5,2) AS rating_score, 0 AS review_count, -1::BIGINT AS seller_code, 10 AS platform_id,
          ({SOLD_SQL})::BIGINT AS sold, {_versions(date_id)}
        FROM listing WHERE platform_id = 10 AND date_id = {date_id} AND p_size <> 7"""
    return f"""{body}
      QUALIFY row_number() OVER (PARTITION BY product_code, seller_code
        ORDER BY product_name, product_description, product_image, product_url, price, sold) = 1"""
