"""Declared types: landing records and warehouse tables."""

from __future__ import annotations

# Marketplace numbers. The names are seeded where a warehouse has none yet.
PLATFORMS = {10: "P10", 11: "P11", 12: "P12"}
P10, P11, P12 = 10, 11, 12

# Codes and names of the unknown members.
UNKNOWN_CODE = -1
UNKNOWN_LOCATION_ID = -1
UNKNOWN_SELLER_NAME = "No Seller"
UNKNOWN_BRAND_NAME = "No Brand"
UNKNOWN_CATEGORY_NAME = "Khác"
UNKNOWN_LOCATION_NAME = "Chưa rõ"
UNKNOWN_URL = "No url"

MONEY = "decimal(15,2)"
RATE = "decimal(5,2)"
AMOUNT = "decimal(38,2)"

# One sold product, seen at one marketplace from one seller.
PRODUCT_KEY = ["product_code", "platform_id", "seller_id"]

# Columns that make a new product version when they change.
VERSIONED = [
    "product_name",
    "product_url",
    "price",
    "original_price",
    "discount_rate",
    "rating_score",
    "review_count",
    "sold",
]

# Fact identity in the anti-joins of the incremental loads.
FACT_KEYS = {
    P10: ["category_id", "brand_id", "seller_id", "product_id", "location_id"],
    P11: ["category_id", "brand_id", "seller_id", "product_id", "location_id"],
    P12: ["category_id", "brand_id", "seller_id", "product_id", "location_id", "platform_id"],
}
PERIODIC_KEYS = ["category_id", "brand_id", "seller_id", "product_id", "location_id", "platform_id"]

DETAIL_P12 = """struct<
    name: string, short_description: string, thumbnail_url: string, short_url: string,
    price: double, original_price: double, discount_rate: double, rating_average: double,
    review_count: bigint, all_time_quantity_sold: bigint,
    brand: struct<id: bigint, name: string>,
    current_seller: struct<id: bigint, name: string, link: string>>"""

LANDING_P12 = f"product_id string, category_id string, timestamp string, data {DETAIL_P12}"

LANDING_P12_LIST = "product_id string, seller_product_id string, timestamp string"

PRODUCT_P11 = """struct<
    itemId: string, name: string, image: string, itemUrl: string, price: string,
    originalPrice: string, discount: string, ratingScore: string, review: string,
    sellerId: string, sellerName: string, brandId: string, brandName: string,
    location: string, itemSoldCntShow: string>"""

LANDING_P11 = f"""
    products array<{PRODUCT_P11}>,
    main_info struct<trackParams: struct<category: string>, totalResults: string, pageSize: string>,
    seo_info string, timestamp double
"""

LANDING_P10 = """
    category array<struct<category_id: string, category_name: string, parent_id: string>>,
    url string, image string, title string, promotions array<string>,
    price struct<current_price: string, original_price: string, discount_rate: string>,
    sold string, location string
"""

LANDING = {P10: LANDING_P10, P11: LANDING_P11, P12: LANDING_P12}

TREE_P11 = """array<struct<
    id: string, categoryName: string,
    level2TabList: array<struct<
        categoryId: string, categoryName: string, categoryUrl: string,
        level3TabList: array<struct<categoryId: string, categoryName: string, categoryUrl: string>>>>>>"""

TREE_ROW = """
    category_code bigint, platform_id int, category_name string, category_url string,
    parent_code bigint, level int
"""

TABLES = {
    "dim_platform": "platform_id int, platform_name string",
    "dim_date": "date_id bigint, date date, day int, month int, year int, quarter int",
    "dim_category": """category_id bigint, category_code bigint, platform_id int, category_name string,
        category_url string, parent_id bigint, level int""",
    "dim_brand": "brand_id bigint, brand_code bigint, brand_name string, platform_id int",
    "dim_seller": "seller_id bigint, seller_code bigint, seller_name string, seller_url string, platform_id int",
    "dim_location": "location_id bigint, location_name string",
    "dim_product": f"""product_id bigint, product_code string, product_name string, product_description string,
        product_image string, product_url string, price {MONEY}, original_price {MONEY}, discount_rate {RATE},
        rating_score {RATE}, review_count int, seller_id bigint, sold bigint, effective_date date, flag boolean,
        platform_id int, expired_date date""",
    "fact_sales": f"""sale_id bigint, date_id bigint, category_id bigint, brand_id bigint, seller_id bigint,
        product_id bigint, product_code string, location_id bigint, units_sold bigint,
        total_sales_amount {AMOUNT}, platform_id int""",
    "fact_periodic_sales": f"""snapshot_id bigint, date_id bigint, category_id bigint, seller_id bigint,
        product_id bigint, product_code string, brand_id bigint, location_id bigint, units_sold bigint,
        total_sales_amount {AMOUNT}, report_period string, platform_id int""",
}

# Large tables are laid out by the columns their readers filter on.
PARTITIONS = {
    "dim_product": ["platform_id", "expired_date"],
    "fact_sales": ["platform_id", "date_id"],
    "fact_periodic_sales": ["platform_id"],
}

# Facts may lie in buckets of one product and seller, where the warehouse was created with a number of buckets.
BUCKETED = {"fact_sales": ["product_code", "seller_id"], "fact_periodic_sales": ["product_code", "seller_id"]}

# Facts whose latest rows per product are kept in a table of their own, with the id that tells what is new.
LATEST = {"fact_sales": ("latest_sales", "sale_id"), "fact_periodic_sales": ("latest_growth", "snapshot_id")}

# Fixed value: the marketplace whose landing files are indented arrays over several lines.
MULTILINE_LANDING = frozenset({P10})
