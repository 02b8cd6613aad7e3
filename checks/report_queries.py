"""Reports, their rollups, pages, filters and the joins below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import star
from checks.registry import check
from checks.star import REGION, over_star
from tradewind.operators import filters, joins, ranking, rollups, sets, trees, windows
from tradewind.plans import reports
from tradewind.schemas import PRODUCT_KEY

ROOT_CODE = ord("E") * 100 + len("ECONOMY")
ROOT_ID = 12 * REGION + ROOT_CODE
WORDS = "Ring, bolt"
GROWTH_PERIODS = {
    "7-DAY": "('7-DAY')",
    "30-DAY": "('14-DAY', '21-DAY', '30-DAY')",
    "60-DAY": "('60-DAY')",
}
LONGEST = """CASE report_period WHEN '30-DAY' THEN 3 WHEN '21-DAY' THEN 2 WHEN '14-DAY' THEN 1 ELSE 0 END"""
KEY = "product_code, platform_id, seller_id"


def _subtree_sql(category: int, platform: int) -> str:
    return f"""below(category_id, depth) AS (
  SELECT category_id, 0 FROM dim_category WHERE category_id = {category} AND platform_id = {platform}
  UNION ALL
  SELECT c.category_id, depth + 1 FROM dim_category c JOIN below b ON c.parent_id = b.category_id WHERE depth < 3)"""


def _keyword_sql(words: str | None) -> str:
    if words is None:
        return "true"
    likes = [
        f"lower({col}) LIKE '%{word.strip().lower()}%'"
        for word in words.split(",")
        for col in ("category_name", "product_name", "product_description")
    ]
    return "(" + " OR ".join(likes) + ")"


def growth_sql(platform=None, category=None, period="30-DAY", words=None) -> str:
    """Named parts that end in `report`."""
    parts = [] if category is None else [_subtree_sql(category, platform)]
    parts.append(
        f"""recent AS (
  SELECT f.* FROM fact_periodic_sales f
  JOIN (SELECT {KEY}, max(date_id) AS date_id FROM fact_periodic_sales GROUP BY ALL) m
    USING (product_code, platform_id, seller_id, date_id)
  WHERE units_sold > 0 AND total_sales_amount > 0 AND report_period IN {GROWTH_PERIODS[period]}
    {f"AND platform_id = {platform}" if platform else ""})"""
    )
    parts.append(
        f"""chosen AS (
  SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {LONGEST} DESC, snapshot_id) = 1)"""
    )
    parts.append(
        f"""report AS (
  SELECT f.snapshot_id AS id, f.date_id, d.date AS updated_date, f.platform_id, platform_name, f.category_id,
         category_name, f.seller_id, seller_name, p.product_code, product_name, product_image, product_url,
         p.price AS product_price, p.review_count AS product_review_count, p.sold AS product_all_time_sold,
         f.brand_id, brand_name, f.location_id, location_name, f.units_sold AS sold,
         f.total_sales_amount AS amount, f.report_period AS period
  FROM chosen f JOIN dim_date d ON d.date_id = f.date_id JOIN dim_category c ON c.category_id = f.category_id
  JOIN dim_product p ON p.product_id = f.product_id AND p.flag JOIN dim_location l ON l.location_id = f.location_id
  JOIN dim_seller s ON s.seller_id = f.seller_id JOIN dim_brand b ON b.brand_id = f.brand_id
  JOIN dim_platform t ON t.platform_id = f.platform_id
  WHERE {_keyword_sql(words)}
    {"AND f.category_id IN (SELECT category_id FROM below)" if category is not None else ""})"""
    )
    return "WITH " + ",\n".join(parts)


def sales_sql(platform=None, category=None, words=None) -> str:
    parts = [] if category is None else [_subtree_sql(category, platform)]
    parts.append(
        f"""report AS (
  SELECT f.sale_id AS id, f.date_id, d.date AS updated_date, f.platform_id, platform_name, f.category_id,
         category_name, f.seller_id, seller_name, p.product_code, product_name, product_image, product_url,
         p.price AS product_price, p.review_count AS product_review_count, p.rating_score AS product_rating_score,
         f.brand_id, brand_name, f.location_id, location_name, f.units_sold AS total_sold,
         f.total_sales_amount AS total_amount
  FROM fact_sales f
  JOIN (SELECT {KEY}, max(date_id) AS date_id FROM fact_sales GROUP BY ALL) m
    USING (product_code, platform_id, seller_id, date_id)
  JOIN dim_date d ON d.date_id = f.date_id JOIN dim_category c ON c.category_id = f.category_id
  JOIN dim_product p ON p.product_id = f.product_id AND p.flag JOIN dim_location l ON l.location_id = f.location_id
  JOIN dim_seller s ON s.seller_id = f.seller_id JOIN dim_brand b ON b.brand_id = f.brand_id
  JOIN dim_platform t ON t.platform_id = f.platform_id
  WHERE units_sold > 0 AND total_sales_amount > 0 AND {_keyword_sql(words)}
    {f"AND f.platform_id = {platform}" if platform else ""}
    {"AND f.category_id IN (SELECT category_id FROM below)" if category is not None else ""})"""
    )
    return "WITH " + ",\n".join(parts)


def _growth(spark: SparkSession, sf: str, **params) -> DataFrame:
    return reports.growth_report(star.tables(spark, sf), **params)


def _sales(spark: SparkSession, sf: str, **params) -> DataFrame:
    return reports.sales_report(star.tables(spark, sf), **params)


# ---- reports ----


@check("RPT-1 JOI-14 FLT-5 WIN-4", over_star(growth_sql(12, None, "30-DAY") + " SELECT * FROM report"))
def growth_report_platform(spark: SparkSession, sf: str) -> DataFrame:
    return _growth(spark, sf, platform_id=12, period="30-DAY")


@check("RPT-1 FLT-2", over_star(growth_sql(None, None, "60-DAY") + " SELECT * FROM report"))
def growth_report_all_platforms(spark: SparkSession, sf: str) -> DataFrame:
    return _growth(spark, sf, period="60-DAY")


@check("RPT-1 FLT-6 FLT-7 JOI-15", over_star(growth_sql(12, ROOT_ID, "60-DAY", WORDS) + " SELECT * FROM report"))
def growth_report_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _growth(spark, sf, platform_id=12, category_id=ROOT_ID, period="60-DAY", keywords=WORDS)


@check("RPT-1 FLT-5", over_star(growth_sql(11, None, "7-DAY") + " SELECT * FROM report"))
def growth_report_week(spark: SparkSession, sf: str) -> DataFrame:
    return _growth(spark, sf, platform_id=11, period="7-DAY")


@check("RPT-2 JOI-14", over_star(sales_sql(12) + " SELECT * FROM report"))
def best_seller_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sales(spark, sf, platform_id=12)


@check("RPT-2 JOI-15 FLT-6 FLT-7", over_star(sales_sql(12, ROOT_ID, WORDS) + " SELECT * FROM report"))
def best_seller_report_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _sales(spark, sf, platform_id=12, category_id=ROOT_ID, keywords=WORDS)


_PAGED = """, counted AS (SELECT count(*) AS n FROM report),
ranked AS (
  SELECT report.*, row_number() OVER (ORDER BY {measure} DESC, md5(id::VARCHAR)) AS rn,
         least({page}, ceil(n / 10.0))::INT AS current_page, 10 AS page_size, ceil(n / 10.0)::INT AS total_page
  FROM report, counted)
SELECT {columns}, current_page, page_size, total_page FROM ranked
WHERE rn BETWEEN (current_page - 1) * 10 + 1 AND current_page * 10"""
_GROWTH_CARD = """product_name, product_image, product_url, product_price, product_review_count,
  product_all_time_sold, sold AS total_sold, amount AS total_amount"""
_BEST_CARD = """product_name, product_image, product_url, product_price, product_review_count,
  product_rating_score, category_name, seller_name, brand_name, location_name, total_sold, total_amount"""


@check("SRT-3", over_star(growth_sql(12) + _PAGED.format(measure="sold", page=2, columns=_GROWTH_CARD)))
def growth_page_by_units(spark: SparkSession, sf: str) -> DataFrame:
    return reports.growth_page(_growth(spark, sf, platform_id=12), rollups.SALES, 2)


@check("SRT-3", over_star(growth_sql(12) + _PAGED.format(measure="amount", page=9999, columns=_GROWTH_CARD)))
def growth_page_last_by_amount(spark: SparkSession, sf: str) -> DataFrame:
    return reports.growth_page(_growth(spark, sf, platform_id=12), rollups.REVENUE, 9999)


@check("SRT-4 RPT-4 FLT-10", over_star(sales_sql(12) + _PAGED.format(measure="total_sold", page=3, columns=_BEST_CARD)))
def best_seller_page_by_units(spark: SparkSession, sf: str) -> DataFrame:
    params = {"platform_id": 12, "category_id": -99, "order_by": "sold", "keywords": " "}
    return reports.best_sellers(star.tables(spark, sf), params, 3)


@check("SRT-4", over_star(sales_sql(10) + _PAGED.format(measure="total_amount", page=1, columns=_BEST_CARD)))
def best_seller_page_by_amount(spark: SparkSession, sf: str) -> DataFrame:
    return reports.best_seller_page(_sales(spark, sf, platform_id=10), "revenue", 1)


@check(
    "SRT-4 SRT-1",
    over_star(
        sales_sql(11)
        + " SELECT id, row_number() OVER (ORDER BY total_sold DESC, md5(id::VARCHAR)) AS position FROM report"
    ),
)
def best_seller_positions(spark: SparkSession, sf: str) -> DataFrame:
    report = _sales(spark, sf, platform_id=11).select("id", "total_sold")
    return ranking.numbered(report, "total_sold", ["id"]).select("id", "position")


@check(
    "RPT-3 AGG-5",
    over_star(
        growth_sql(12, None, "30-DAY")
        + """ SELECT max(updated_date) AS most_recent_date, coalesce(sum(sold), 0)::BIGINT AS total_sold,
          coalesce(sum(amount), 0)::DECIMAL(38,2) AS total_revenue,
          count(DISTINCT (product_code, platform_id, seller_id)) AS total_products,
          count(DISTINCT seller_id) AS total_sellers FROM report"""
    ),
)
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.summary(_growth(spark, sf, platform_id=12))


_TOP = """ SELECT name, value FROM (
  SELECT {what}_id, {what}_name AS name, {value} AS value FROM report GROUP BY ALL)
  ORDER BY value DESC, name, {what}_id LIMIT {k}"""
_UNITS, _MONEY = "sum(sold)::BIGINT", "trunc(sum(amount))::BIGINT"


@check("AGG-6 SRT-2 SCA-20", over_star(growth_sql(12) + _TOP.format(what="category", value=_MONEY, k=20)))
def top_categories_by_amount(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_categories(_growth(spark, sf, platform_id=12), rollups.REVENUE)


@check("AGG-6 SRT-2", over_star(growth_sql(12) + _TOP.format(what="category", value=_UNITS, k=20)))
def top_categories_by_units(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_categories(_growth(spark, sf, platform_id=12), rollups.SALES)


@check("AGG-7 SRT-2", over_star(growth_sql(12, None, "60-DAY") + _TOP.format(what="seller", value=_UNITS, k=20)))
def top_sellers_by_units(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_sellers(_growth(spark, sf, platform_id=12, period="60-DAY"), rollups.SALES)


@check("AGG-7 SRT-2", over_star(growth_sql(12, None, "60-DAY") + _TOP.format(what="seller", value=_MONEY, k=20)))
def top_sellers_by_amount(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_sellers(_growth(spark, sf, platform_id=12, period="60-DAY"), rollups.REVENUE)


@check("AGG-8 SRT-2", over_star(growth_sql(11, None, "60-DAY") + _TOP.format(what="brand", value=_UNITS, k=15)))
def top_brands_by_units(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_brands(_growth(spark, sf, platform_id=11, period="60-DAY"), rollups.SALES)


@check("AGG-8 SRT-2", over_star(growth_sql(11, None, "60-DAY") + _TOP.format(what="brand", value=_MONEY, k=15)))
def top_brands_by_amount(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_brands(_growth(spark, sf, platform_id=11, period="60-DAY"), rollups.REVENUE)


@check("AGG-9 SRT-2", over_star(growth_sql(10, None, "60-DAY") + _TOP.format(what="location", value=_UNITS, k=10)))
def top_locations_by_units(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_locations(_growth(spark, sf, platform_id=10, period="60-DAY"), rollups.SALES)


@check("AGG-9 SRT-2", over_star(growth_sql(10, None, "60-DAY") + _TOP.format(what="location", value=_MONEY, k=10)))
def top_locations_by_amount(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_locations(_growth(spark, sf, platform_id=10, period="60-DAY"), rollups.REVENUE)


_PLATFORM = "SELECT platform_name AS name, {value} AS value FROM report GROUP BY platform_id, platform_name"


@check("AGG-10", over_star(growth_sql(None, None, "60-DAY") + _PLATFORM.format(value=_UNITS)))
def platform_units(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.by_platform(_growth(spark, sf, period="60-DAY"), rollups.SALES)


@check("AGG-10", over_star(growth_sql(None, None, "60-DAY") + _PLATFORM.format(value=_MONEY)))
def platform_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.by_platform(_growth(spark, sf, period="60-DAY"), rollups.REVENUE)


@check(
    "AGG-13",
    over_star(
        growth_sql(None, None, "60-DAY")
        + f""", amounts AS ({_PLATFORM.format(value=_MONEY)})
        SELECT name, value, round(value * 100.0 / sum(value) OVER (), 2)::DECIMAL(5,2) AS percent FROM amounts"""
    ),
)
def platform_share(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.platform_share(_growth(spark, sf, period="60-DAY"), rollups.REVENUE)


_BANDS = """, bands AS (SELECT * FROM (VALUES
  (1, '< 10,000đ', 0, 10000), (2, '10,000 - 50,000đ', 10000, 50000), (3, '50,000 - 100,000đ', 50000, 100000),
  (4, '100,000 - 200,000đ', 100000, 200000), (5, '200,000 - 500,000đ', 200000, 500000),
  (6, '500,000 - 1,000,000đ', 500000, 1000000), (7, '1,000,000 - 3,000,000đ', 1000000, 3000000),
  (8, '> 3,000,000đ', 3000000, 999999999999)) t(band, price_range, lower_bound, upper_bound)),
banded AS (
  SELECT band, price_range, platform_name, sum(sold)::BIGINT AS sold, trunc(sum(amount))::BIGINT AS amount
  FROM report JOIN bands ON product_price >= lower_bound AND product_price < upper_bound GROUP BY ALL)"""


@check(
    "AGG-11",
    over_star(
        sales_sql().replace("total_sold", "sold").replace("total_amount", "amount")
        + _BANDS
        + """ SELECT band, price_range, (sum(sold) OVER (PARTITION BY band))::BIGINT AS total_sold, platform_name,
                amount FROM banded"""
    ),
)
def price_bands(spark: SparkSession, sf: str) -> DataFrame:
    report = _sales(spark, sf).withColumnsRenamed({"total_sold": "sold", "total_amount": "amount"})
    bands = rollups.price_bands(report)
    return bands.select(
        "band", "price_range", "total_sold", F.explode("platform_amounts").alias("platform_name", "amount")
    )


@check(
    "AGG-14",
    over_star(
        growth_sql(None, None, "60-DAY")
        + _BANDS
        + """ SELECT band, price_range, coalesce(sum(amount) FILTER (platform_name = 'P10'), 0)::BIGINT AS "P10",
                coalesce(sum(amount) FILTER (platform_name = 'P11'), 0)::BIGINT AS "P11",
                coalesce(sum(amount) FILTER (platform_name = 'P12'), 0)::BIGINT AS "P12"
              FROM banded GROUP BY band, price_range"""
    ),
)
def price_band_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.band_pivot(_growth(spark, sf, period="60-DAY"))


@check(
    "AGG-12",
    over_star(
        growth_sql(11, None, "60-DAY")
        + f", chart AS ({_TOP.format(what='brand', value=_MONEY, k=15)})"
        + " SELECT count(DISTINCT name) > 1 AS visible FROM chart"
    ),
)
def chart_visible(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.chart_visible(rollups.top_brands(_growth(spark, sf, platform_id=11, period="60-DAY")))


@check("PRJ-17", over_star(growth_sql(12) + f" SELECT {_GROWTH_CARD} FROM report"))
def product_cards(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.product_cards(_growth(spark, sf, platform_id=12))


@check("PRJ-17", over_star(sales_sql(10) + f" SELECT {_BEST_CARD} FROM report"))
def best_seller_cards(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.best_seller_cards(_sales(spark, sf, platform_id=10))


@check(
    "SCA-9 RPT-3",
    over_star(
        growth_sql(12)
        + " SELECT (max(updated_date) - INTERVAL 30 DAY)::DATE AS from_date, max(updated_date) AS to_date FROM report"
    ),
)
def report_dates(spark: SparkSession, sf: str) -> DataFrame:
    return reports.report_dates(_growth(spark, sf, platform_id=12), "30-DAY")


_BUNDLE = (
    growth_sql(12)
    + """, long AS (
  SELECT 'summary' AS section, 'sold' AS name, sum(sold)::BIGINT AS value FROM report
  UNION ALL SELECT 'page', 'total_page', ceil(count(*) / 10.0)::BIGINT FROM report"""
    + "".join(
        f"""
  UNION ALL SELECT '{section}', name, value FROM ({_TOP.format(what=what, value=_MONEY, k=k)})"""
        for section, what, k in (
            ("categories", "category", 20),
            ("sellers", "seller", 20),
            ("brands", "brand", 15),
            ("locations", "location", 10),
        )
    )
    + ") SELECT * FROM long"
)


@check("RPT-3 FLT-10", over_star(_BUNDLE))
def analysis_bundle(spark: SparkSession, sf: str) -> DataFrame:
    params = {"platform_id": 12, "category_id": -99, "period": "30-DAY", "keywords": ""}
    frames = reports.analysis(star.tables(spark, sf), params, rollups.REVENUE)

    def section(title: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(title).alias("section"), "name", "value")

    charts = [section(title, frames[title]) for title in ("categories", "sellers", "brands", "locations")]
    total = frames["summary"].select(F.lit("sold").alias("name"), F.col("total_sold").alias("value"))
    pages = frames["page_info"].select(
        F.lit("total_page").alias("name"), F.col("total_page").cast("bigint").alias("value")
    )
    return sets.union_all(section("summary", total), section("page", pages), *charts)


@check(
    "RPT-5 FLT-9",
    over_star(
        """SELECT 'platform' AS kind, platform_name AS name FROM dim_platform
        UNION ALL SELECT 'category', category_name FROM dim_category WHERE platform_id = 12 AND parent_id IS NULL
        UNION ALL SELECT 'period', unnest(['7-DAY', '30-DAY', '60-DAY'])"""
    ),
)
def filter_options(spark: SparkSession, sf: str) -> DataFrame:
    options = reports.filter_options(star.tables(spark, sf), 12)
    names = {"platforms": "platform_name", "categories": "category_name", "periods": "period"}
    kinds = {"platforms": "platform", "categories": "category", "periods": "period"}
    return sets.union_all(
        *[f.select(F.lit(kinds[k]).alias("kind"), F.col(names[k]).alias("name")) for k, f in options.items()]
    )


# ---- filters ----


@check(
    "FLT-1",
    over_star(
        "SELECT product_id, price FROM dim_product WHERE (platform_id = 12 OR platform_id = 10) AND flag"
        " AND effective_date = DATE '2001-08-15'"
    ),
)
def filter_equality(spark: SparkSession, sf: str) -> DataFrame:
    on_platform = (F.col("platform_id") == 12) | (F.col("platform_id") == 10)
    day = F.col("effective_date") == F.lit("2001-08-15").cast("date")
    return filters.where(star.stored(spark, sf, "dim_product"), on_platform & F.col("flag") & day).select("product_id", "price")


@check("FLT-2", over_star("SELECT sale_id FROM fact_sales WHERE date_id = 6"))
def filter_optional(spark: SparkSession, sf: str) -> DataFrame:
    facts = filters.where_opt(star.stored(spark, sf, "fact_sales"), "platform_id", None)
    return filters.where_opt(facts, "date_id", 6).select("sale_id")


@check(
    "FLT-4",
    "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey > 0",
)
def filter_positive(spark: SparkSession, sf: str) -> DataFrame:
    return filters.positive(star.table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]).select("c_custkey")


@check(
    "FLT-5",
    over_star(
        "SELECT snapshot_id, report_period FROM fact_periodic_sales"
        " WHERE report_period IN ('14-DAY', '21-DAY', '30-DAY')"
    ),
)
def filter_period(spark: SparkSession, sf: str) -> DataFrame:
    return filters.period_match(star.stored(spark, sf, "fact_periodic_sales"), "30-DAY").select("snapshot_id", "report_period")


@check(
    "FLT-6 SCA-10 SCA-11",
    """SELECT doc_id FROM documents
       WHERE lower(text) LIKE '%the%ing%' OR lower(text) LIKE '%d_r%' OR lower(source) LIKE '%the%ing%'
          OR lower(source) LIKE '%d_r%'""",
)
def filter_keywords(spark: SparkSession, sf: str) -> DataFrame:
    documents = star.table(spark, sf, "documents")
    return filters.keyword_match(documents, " THE%ing , D_r", ["text", "source"]).select("doc_id")


@check(
    "FLT-7 JOI-15",
    over_star(
        f"WITH {_subtree_sql(ROOT_ID, 12)}"
        " SELECT sale_id FROM fact_sales f WHERE EXISTS (SELECT 1 FROM below b WHERE b.category_id = f.category_id)"
    ),
)
def filter_subtree(spark: SparkSession, sf: str) -> DataFrame:
    ids = trees.subtree(star.stored(spark, sf, "dim_category"), 12, ROOT_ID)
    return filters.in_subtree(star.stored(spark, sf, "fact_sales"), ids).select("sale_id")


@check("FLT-8", "SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49) AS found")
def row_exists(spark: SparkSession, sf: str) -> DataFrame:
    return filters.exists_row(star.table(spark, sf, "lineitem"), F.col("l_quantity") > 49)


@check(
    "FLT-9",
    over_star(
        "SELECT category_id, category_name FROM dim_category WHERE platform_id = 11 AND parent_id IS NULL"
    ),
)
def root_categories(spark: SparkSession, sf: str) -> DataFrame:
    return filters.root_categories(star.stored(spark, sf, "dim_category"), 11).select("category_id", "category_name")


# ---- joins ----


@check("JOI-15 SET-1", over_star(f"WITH {_subtree_sql(ROOT_ID, 12)} SELECT DISTINCT category_id FROM below"))
def category_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return trees.subtree(star.stored(spark, sf, "dim_category"), 12, ROOT_ID)


_LATEST = f"""SELECT sale_id, f.date_id FROM fact_sales f
  JOIN (SELECT {KEY}, max(date_id) AS date_id FROM fact_sales GROUP BY ALL) USING ({KEY}, date_id)"""


@check("JOI-13 AGG-4", over_star(_LATEST))
def latest_rows_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return windows.latest_rows(star.stored(spark, sf, "fact_sales"), PRODUCT_KEY).select("sale_id", "date_id")


@check("AGG-4", over_star(f"SELECT {KEY}, max(date_id) AS max_date_id FROM fact_sales GROUP BY ALL"))
def max_date_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return windows.max_per_key(star.stored(spark, sf, "fact_sales"), "date_id", PRODUCT_KEY)


@check(
    "JOI-14",
    over_star(
        """SELECT f.sale_id, product_name, seller_name, category_name, brand_name, location_name, d.date, platform_name
        FROM fact_sales f JOIN dim_date d ON d.date_id = f.date_id JOIN dim_category c ON c.category_id = f.category_id
        JOIN dim_product p ON p.product_id = f.product_id AND p.flag
        JOIN dim_location l ON l.location_id = f.location_id JOIN dim_seller s ON s.seller_id = f.seller_id
        JOIN dim_brand b ON b.brand_id = f.brand_id JOIN dim_platform t ON t.platform_id = f.platform_id"""
    ),
)
def star_join(spark: SparkSession, sf: str) -> DataFrame:
    frames = star.tables(spark, sf)
    return joins.star(frames["fact_sales"], frames).select(
        "sale_id",
        "product_name",
        "seller_name",
        "category_name",
        "brand_name",
        "location_name",
        "date",
        "platform_name",
    )


@check("JOI-16", over_star("SELECT sale_id, date FROM fact_sales JOIN dim_date USING (date_id)"))
def facts_with_date(spark: SparkSession, sf: str) -> DataFrame:
    return joins.with_date(star.stored(spark, sf, "fact_sales"), star.stored(spark, sf, "dim_date")).select("sale_id", "date")


# ---- aggregates, windows, order, sets ----


@check("AGG-1", "SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.n_rows(star.table(spark, sf, "lineitem"))


@check("AGG-2", over_star("SELECT count(DISTINCT level) AS n FROM dim_category"))
def distinct_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.n_distinct(star.stored(spark, sf, "dim_category"), "level")


@check(
    "AGG-3",
    over_star("SELECT sale_id FROM fact_sales WHERE date_id = (SELECT max(date_id) FROM fact_sales)"),
)
def newest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return joins.at_global_max(star.stored(spark, sf, "fact_sales"), "date_id").select("sale_id")


@check("AGG-15", over_star("SELECT DISTINCT platform_id, category_id, brand_id FROM fact_sales"))
def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return sets.distinct_keys(star.stored(spark, sf, "fact_sales"), ["platform_id", "category_id", "brand_id"])


@check(
    "WIN-1",
    over_star(
        f"""SELECT sale_id, units_sold FROM fact_sales
        QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY date_id DESC, sale_id DESC) = 1"""
    ),
)
def latest_row_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return windows.latest_per_key(star.stored(spark, sf, "fact_sales"), PRODUCT_KEY).select("sale_id", "units_sold")


@check(
    "WIN-2",
    over_star(f"SELECT sale_id, max(date_id) OVER (PARTITION BY {KEY}) AS max_date_id FROM fact_sales"),
)
def partition_max(spark: SparkSession, sf: str) -> DataFrame:
    return windows.with_partition_max(star.stored(spark, sf, "fact_sales"), "date_id", PRODUCT_KEY).select(
        "sale_id", "max_date_id"
    )


@check(
    "WIN-3",
    over_star(f"SELECT sale_id, row_number() OVER (PARTITION BY {KEY} ORDER BY date_id DESC) AS rn FROM fact_sales"),
)
def snapshot_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return windows.rank_snapshots(star.stored(spark, sf, "fact_sales"), PRODUCT_KEY).select("sale_id", "rn")


@check(
    "WIN-4",
    over_star(
        f"""SELECT snapshot_id, report_period FROM fact_periodic_sales
        QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {LONGEST} DESC, snapshot_id) = 1"""
    ),
)
def longest_period_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return windows.longest_period(star.stored(spark, sf, "fact_periodic_sales"), PRODUCT_KEY).select(
        "snapshot_id", "report_period"
    )


@check(
    "WIN-5",
    over_star(
        f"""SELECT product_id, effective_date FROM dim_product
        QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY effective_date DESC, product_id DESC) = 1"""
    ),
)
def latest_product_version(spark: SparkSession, sf: str) -> DataFrame:
    return windows.latest_version(star.stored(spark, sf, "dim_product"), PRODUCT_KEY).select("product_id", "effective_date")


@check("SRT-1", over_star(f"SELECT {KEY}, units_sold FROM fact_periodic_sales ORDER BY {KEY}"))
def ordered_growth(spark: SparkSession, sf: str) -> DataFrame:
    rows = star.stored(spark, sf, "fact_periodic_sales").select(*PRODUCT_KEY, "units_sold")
    return ranking.order(rows, PRODUCT_KEY)


@check(
    "SRT-2",
    "SELECT l_suppkey AS supplier, sum(l_quantity::BIGINT)::BIGINT AS units FROM lineitem GROUP BY ALL"
    " ORDER BY units DESC, supplier LIMIT 20",
)
def top_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    grouped = (
        star.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("supplier"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    )
    return ranking.top_k(grouped, "units", 20, ["supplier"])


@check(
    "SRT-5",
    """WITH pages AS (SELECT o_custkey, ceil(count(*) / 10.0)::INT AS total FROM orders GROUP BY ALL)
    SELECT o_custkey, batch, (batch - 1) * 15 + 1 AS start_page, least(batch * 15, total) AS end_page
    FROM pages, (SELECT unnest([1, 2])::INT AS batch)""",
)
def page_batches(spark: SparkSession, sf: str) -> DataFrame:
    pages = star.table(spark, sf, "orders").groupBy("o_custkey").agg(F.ceil(F.count("*") / 10).cast("int").alias("total"))
    batches = pages.select("o_custkey", "total", F.explode(F.array(F.lit(1), F.lit(2))).alias("batch"))
    start, end = ranking.page_batch(F.col("batch"), F.lit(15), F.col("total"))
    return batches.select("o_custkey", "batch", start.alias("start_page"), end.alias("end_page"))


@check(
    "SET-1",
    "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey"
    " FROM nation",
)
def nations_in_use(spark: SparkSession, sf: str) -> DataFrame:
    customer = star.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    supplier = star.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    nation = star.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    return sets.union_distinct(customer, supplier, nation)


@check(
    "SET-2",
    "SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier"
    " UNION ALL SELECT c_nationkey, c_acctbal FROM customer",
)
def all_balances(spark: SparkSession, sf: str) -> DataFrame:
    supplier = star.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    customer = star.table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")
    )
    return sets.union_all(supplier, customer)
