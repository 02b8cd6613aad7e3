"""Cleaning, trees, lookups, change detection and loads."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import landing, star
from checks.landing import NO_BRAND, NO_CATEGORY, NO_SELLER, image_sql
from checks.registry import check
from checks.star import CUTOFFS, REGION, over_star
from tradewind import functions as X
from tradewind.operators import cleaning, joins, scd, trees, windows
from tradewind.operators.keys import assign_ids
from tradewind.operators.sets import union_all
from tradewind.operators.skew import colocated, join_large
from tradewind.plans import dimensions, facts, growth, incremental, products
from tradewind.plans.warehouse import Warehouse, latest_facts, staging
from tradewind.schemas import FACT_KEYS, MULTILINE_LANDING, PERIODIC_KEYS, PLATFORMS, PRODUCT_KEY
from tradewind.session import scratch_path
from tradewind.sinks.files import write_arrays, write_chunks
from tradewind.sources.landing import latest_batch
from tradewind.streaming.landing_stream import run_incremental_stream

DAYS = dict(CUTOFFS)
KEY = "product_code, platform_id, seller_id"


def _flat(spark: SparkSession, sf: str, platform_id: int, date_id: int) -> DataFrame:
    return cleaning.flat_listing(landing.landing(spark, sf, platform_id, date_id), platform_id)


# ---- projections and cleaning ----


@check("PRJ-11 PRJ-14 PRJ-15 SCA-2 SCA-3", over_star(image_sql(12, 6)))
def products_p12(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.product_rows_p12(_flat(spark, sf, 12, 6), DAYS[6])


@check("PRJ-12 PRJ-1 SCA-14 SCA-15", over_star(image_sql(11, 6)))
def products_p11(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.product_rows_p11(_flat(spark, sf, 11, 6), DAYS[6])


@check("PRJ-13 SCA-12 SCA-13 SCA-15", over_star(image_sql(10, 6)))
def products_p10(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.product_rows_p10(_flat(spark, sf, 10, 6), DAYS[6])


@check(
    "PRJ-1",
    over_star(
        f"""SELECT v.prefix || p_partkey AS item, CASE WHEN p_size <> {NO_SELLER} THEN s_suppkey END AS seller,
          CASE WHEN p_size <= {NO_CATEGORY} THEN c3 END AS category_id, 11 AS platform_id
        FROM listing, (VALUES (''), ('v')) v(prefix) WHERE platform_id = 11 AND date_id = 6"""
    ),
)
def unnested_products(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.unnest(
        landing.landing(spark, sf, 11, 6),
        "products",
        {"category_id": X.to_type(F.trim("main_info.trackParams.category"), "bigint"), "platform_id": F.lit(11)},
    )
    return rows.select(
        F.trim("product.itemId").alias("item"),
        X.to_type(F.trim("product.sellerId"), "bigint").alias("seller"),
        "category_id",
        "platform_id",
    )


@check(
    "PRJ-2",
    over_star(
        f"""WITH kids AS (
          SELECT DISTINCT c1 AS category_code, p_type || ' ' || p_size % 5 AS category_name, c0 AS parent_code, 1 AS level
          FROM listing WHERE platform_id = 10 AND date_id = 6 AND p_size <= {NO_CATEGORY}
          UNION SELECT DISTINCT c0, p_type, -1, 0 FROM listing WHERE platform_id = 10 AND date_id = 6)
        SELECT *, 10 AS platform_id, 'No url' AS category_url FROM kids"""
    ),
)
def nested_categories(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.category_rows_nested(landing.landing(spark, sf, 10, 6))


@check(
    "PRJ-3 SCA-23",
    over_star(
        f"""SELECT p_partkey::VARCHAR AS code, CASE WHEN p_size <> {NO_BRAND} THEN brand_code END AS brand_code,
          CASE WHEN p_size <> {NO_SELLER} THEN s_name END AS seller_name, 12 AS platform_id
        FROM listing WHERE platform_id = 12 AND date_id = 6"""
    ),
)
def nested_projection(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.project(
        landing.landing(spark, sf, 12, 6),
        {
            "code": "product_id",
            "brand_code": "data.brand.id",
            "seller_name": "data.current_seller.name",
            "platform_id": F.lit(12),
        },
    )


_TREE_COLUMNS = "category_code, platform_id, category_name, category_url, parent_code, level"


def _node(code: Column, name: Column, key: Column, children: Column | None = None) -> Column:
    fields = [code.cast("string").alias("category_id"), name.alias("category_name"), key.alias("category_urlKey")]
    return F.struct(*fields, *([children.alias("children")] if children is not None else []))


@check(
    "PRJ-4",
    """WITH n AS (SELECT p_partkey * 10 AS code, p_name, p_brand, p_size FROM part)
    SELECT code AS category_code, 12 AS platform_id, p_name AS category_name, p_brand AS category_url,
           -1 AS parent_code, 0 AS level FROM n
    UNION ALL SELECT code + 1, 12, p_name || ' 1', p_brand, code, 1 FROM n
    UNION ALL SELECT code + 2, 12, p_name || ' 2', p_brand, code + 1, 2 FROM n
    UNION ALL SELECT code + 3, 12, p_name || ' 3', p_brand, code + 2, 3 FROM n
    UNION ALL SELECT code + 4, 12, p_name || ' 4', '', code, 1 FROM n""",
)
def flattened_tree(spark: SparkSession, sf: str) -> DataFrame:
    name, key, base = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") * 10
    leaf = F.to_json(F.struct((base + 4).cast("string").alias("category_id"), F.concat(name, F.lit(" 4")).alias("category_name")))
    deep = _node(base + 3, F.concat(name, F.lit(" 3")), key)
    middle = _node(base + 2, F.concat(name, F.lit(" 2")), key, F.array(deep))
    first = F.to_json(_node(base + 1, F.concat(name, F.lit(" 1")), key, F.array(middle)))
    root = F.concat(
        F.lit("[{"),
        F.concat_ws(
            ",",
            F.concat(F.lit('"category_id":"'), base, F.lit('"')),
            F.concat(F.lit('"category_name":"'), name, F.lit('"')),
            F.concat(F.lit('"category_urlKey":"'), key, F.lit('"')),
            F.concat(F.lit('"children":['), first, F.lit(","), leaf, F.lit("]")),
        ),
        F.lit("}]"),
    )
    bodies = star.table(spark, sf, "part").select(root.alias("body"))
    return trees.flatten_tree(bodies, "body", 12)


@check(
    "PRJ-5",
    """WITH n AS (SELECT p_partkey * 10 AS code, p_name, p_brand, p_size FROM part)
    SELECT code AS category_code, 11 AS platform_id, p_name AS category_name, '' AS category_url,
           -1 AS parent_code, 0 AS level FROM n
    UNION ALL SELECT CASE WHEN p_size = 9 THEN -1 ELSE code + 1 END, 11, p_name || ' 1', p_brand, code, 1 FROM n
      WHERE p_size > 4
    UNION ALL SELECT code + 2, 11, p_name || ' 2', p_brand, CASE WHEN p_size = 9 THEN -1 ELSE code + 1 END, 2 FROM n
      WHERE p_size > 8""",
)
def flattened_three_levels(spark: SparkSession, sf: str) -> DataFrame:
    name, key, base, size = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") * 10, F.col("p_size")

    def node(code: Column, text: str) -> list[Column]:
        return [
            code.cast("string").alias("categoryId"),
            F.concat(name, F.lit(text)).alias("categoryName"),
            key.alias("categoryUrl"),
        ]

    third = F.when(size > 8, F.array(F.struct(*node(base + 2, " 2")))).alias("level3TabList")
    code = F.when(size == 9, "x").otherwise((base + 1).cast("string"))
    second = F.when(size > 4, F.array(F.struct(*node(code, " 1"), third))).alias("level2TabList")
    tree = F.array(F.struct(base.cast("string").alias("id"), name.alias("categoryName"), second))
    bodies = star.table(spark, sf, "part").select(F.to_json(tree).alias("body"))
    return trees.flatten_tree3(bodies, "body")


@check(
    "PRJ-6",
    over_star(
        """SELECT category_code, platform_id FROM category_tree t WHERE NOT EXISTS (
          SELECT 1 FROM category_tree c WHERE c.parent_code = t.category_code AND c.platform_id = t.platform_id)"""
    ),
)
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return trees.leaves(star.stored(spark, sf, "category_tree")).select("category_code", "platform_id")


@check(
    "PRJ-7",
    over_star(
        """WITH l1 AS (SELECT * FROM category_tree WHERE level = 0 AND lower(trim(category_name)) IN ('economy', 'large')),
        l2 AS (SELECT t.* FROM category_tree t JOIN l1 ON t.parent_code = l1.category_code
                 AND t.platform_id = l1.platform_id
               WHERE t.level = 1 AND lower(trim(t.category_name)) IN ('economy 1', 'economy 3', 'large 0', 'small 2'))
        SELECT t.category_code, t.platform_id FROM category_tree t JOIN l2 ON t.parent_code = l2.category_code
          AND t.platform_id = l2.platform_id"""
    ),
)
def tree_leaves_under(spark: SparkSession, sf: str) -> DataFrame:
    tree = star.stored(spark, sf, "category_tree")
    found = trees.leaves_under(tree, ["economy", "large"], ["economy 1", "economy 3", "large 0", "small 2"])
    return found.select("category_code", "platform_id")


@check(
    "PRJ-8",
    over_star(
        f"""SELECT DISTINCT brand_code, p_brand AS brand_name, platform_id FROM listing
        WHERE date_id = 6 AND platform_id IN (11, 12) AND p_size <> {NO_BRAND}"""
    ),
)
def brand_rows(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(*[cleaning.brand_rows(_flat(spark, sf, p, 6), p) for p in (11, 12)])


@check(
    "PRJ-9",
    over_star(
        f"""SELECT DISTINCT s_suppkey AS seller_code, s_name AS seller_name, platform_id,
          CASE WHEN platform_id = 12 THEN 'https://seller.example.com/' || s_suppkey END AS seller_url
        FROM listing WHERE date_id = 6 AND platform_id IN (11, 12) AND p_size <> {NO_SELLER}"""
    ),
)
def seller_rows(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(*[cleaning.seller_rows(_flat(spark, sf, p, 6), p) for p in (11, 12)])


@check(
    "PRJ-10 SCA-16 SCA-1",
    over_star("SELECT DISTINCT upper(n_name) AS location_name, platform_id FROM listing WHERE platform_id < 12 AND date_id = 6"),
)
def location_rows(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(
        *[
            cleaning.location_rows(_flat(spark, sf, p, 6), p).withColumn("platform_id", F.lit(p).cast("int"))
            for p in (10, 11)
        ]
    )


@check(
    "PRJ-14",
    f"SELECT p_partkey, CASE WHEN p_size <> {NO_BRAND} THEN p_brand END AS brand FROM part WHERE p_size <> {NO_BRAND}",
)
def rows_with_keys(spark: SparkSession, sf: str) -> DataFrame:
    part = star.table(spark, sf, "part")
    brand = F.when(F.col("p_size") != NO_BRAND, F.col("p_brand")).alias("brand")
    return cleaning.drop_null_keys(part.select("p_partkey", brand), ["brand"])


@check(
    "PRJ-15",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) = 1""",
)
def deduplicated_sales(spark: SparkSession, sf: str) -> DataFrame:
    sales = star.table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate"
    )
    order = [F.col("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return cleaning.dedupe(sales, ["l_partkey", "l_suppkey"], order).drop("l_shipdate")


@check("PRJ-16", "SELECT o_orderkey, o_totalprice * 2 AS doubled, 'x' AS o_orderstatus FROM orders")
def replaced_columns(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    doubled = cleaning.with_col(orders, "doubled", F.col("o_totalprice") * 2)
    return cleaning.with_col(doubled, "o_orderstatus", F.lit("x")).drop("o_totalprice")


# ---- lookups and change detection ----


@check(
    "JOI-1 JOI-2",
    over_star(
        f"""SELECT p_partkey::VARCHAR AS product_code, CASE WHEN p_size <> {NO_SELLER} THEN s_suppkey END AS s_suppkey,
          CASE WHEN p_size = {NO_BRAND} THEN 12 ELSE 12 * 100000 + brand_code END AS brand_id
        FROM listing WHERE platform_id = 12 AND date_id = 6"""
    ),
)
def brand_lookup(spark: SparkSession, sf: str) -> DataFrame:
    dim = star.stored(spark, sf, "dim_brand")
    rows = landing.landing(spark, sf, 12, 6).select(
        F.col("product_id").alias("product_code"),
        F.col("data.current_seller.id").alias("s_suppkey"),
        F.col("data.brand.id").alias("brand_code"),
        F.lit(12).alias("platform_id"),
    )
    default = joins.unknown_member(dim, 12, "brand_code", "brand_id")
    found = joins.lookup(rows, dim, ["brand_code", "platform_id"], "brand_id", default)
    return found.select("product_code", "s_suppkey", "brand_id")


@check(
    "JOI-3",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey END::BIGINT AS location_id FROM customer""",
)
def location_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation = star.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = join_large(star.table(spark, sf, "customer"), nation, ["c_nationkey"], "inner")
    place = F.when(F.col("c_acctbal") >= 0, F.col("n_name")).otherwise("nowhere").alias("location_name")
    rows = named.select("c_custkey", place)
    return joins.lookup_location(rows, star.stored(spark, sf, "dim_location")).select("c_custkey", "location_id")


@check(
    "JOI-4 SCA-18",
    over_star(
        """SELECT f.sale_id, p.sold, p.price, (p.sold * p.price)::DECIMAL(38,2) AS value
        FROM fact_sales f JOIN dim_product p USING (product_code, platform_id, seller_id) WHERE p.flag"""
    ),
)
def facts_with_product(spark: SparkSession, sf: str) -> DataFrame:
    sales = star.stored(spark, sf, "fact_sales").select("sale_id", *PRODUCT_KEY)
    joined = joins.attach_product(sales, star.stored(spark, sf, "dim_product"))
    return joined.select("sale_id", "sold", "price", X.amount(F.col("sold"), F.col("price")).alias("value"))


@check("JOI-5", over_star("SELECT seller_code, platform_id FROM dim_seller JOIN supplier ON s_suppkey = seller_code WHERE s_acctbal < 0"))
def new_sellers(spark: SparkSession, sf: str) -> DataFrame:
    image = star.stored(spark, sf, "dim_seller").where("seller_code >= 0")
    known = star.table(spark, sf, "supplier").where("s_acctbal >= 0")
    table = known.select(F.col("s_suppkey").alias("seller_code"), star.platform_of(F.col("s_suppkey")).alias("platform_id"))
    return joins.new_rows(image, table, ["seller_code", "platform_id"]).select("seller_code", "platform_id")


def image_with_ids(spark: SparkSession, sf: str, date_id: int) -> DataFrame:
    return products.product_image(
        _flat(spark, sf, 12, date_id), star.stored(spark, sf, "dim_seller"), 12, DAYS[date_id]
    )


def _written(df: DataFrame, label: str) -> DataFrame:
    """A frame as a load would stage it: written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dim_after(spark: SparkSession, sf: str, date_id: int) -> DataFrame:
    """Product dimension after a first load, as a written table."""
    warehouse = Warehouse(spark, scratch_path(spark, "dim"))
    image = _written(image_with_ids(spark, sf, date_id), "image")
    warehouse.append("dim_product", assign_ids(image, "product_id", PRODUCT_KEY))
    return warehouse.read("dim_product")


def _id_image_sql(date_id: int) -> str:
    return f"""SELECT * EXCLUDE (seller_code, platform_id), 12 AS platform_id,
        CASE WHEN seller_code = -1 THEN -12 ELSE seller_code + 1 END AS seller_id FROM ({image_sql(12, date_id)})"""


_DIGEST = "md5(concat_ws(chr(31), product_code, platform_id, seller_id))"
_CHANGED = " OR ".join(
    f"n.{c} <> o.{c}"
    for c in (
        "product_name",
        "product_url",
        "price",
        "original_price",
        "discount_rate",
        "rating_score",
        "review_count",
        "sold",
    )
)
_VERSIONED = f"""WITH old_image AS ({_id_image_sql(1)}), new_image AS ({_id_image_sql(6)}),
old_dim AS (SELECT row_number() OVER (ORDER BY {_DIGEST}) AS product_id, * FROM old_image),
fresh AS (SELECT * FROM new_image n WHERE NOT EXISTS (SELECT 1 FROM old_dim o
  WHERE n.product_code = o.product_code AND n.seller_id = o.seller_id)),
changed AS (SELECT n.* FROM new_image n JOIN old_dim o USING ({KEY}) WHERE {_CHANGED})"""


@check("JOI-6", over_star(f"{_VERSIONED} SELECT product_code, seller_id, sold FROM fresh"))
def new_products(spark: SparkSession, sf: str) -> DataFrame:
    found = joins.new_products(image_with_ids(spark, sf, 6), dim_after(spark, sf, 1))
    return found.select("product_code", "seller_id", "sold")


@check("JOI-7 FLT-3", over_star(f"{_VERSIONED} SELECT product_code, seller_id, sold FROM changed"))
def changed_products(spark: SparkSession, sf: str) -> DataFrame:
    found = joins.changed_products(image_with_ids(spark, sf, 6), dim_after(spark, sf, 1))
    return found.select("product_code", "seller_id", "sold")


@check(
    "SNK-4 WIN-5",
    over_star(
        f"""{_VERSIONED} SELECT o.product_id, CASE WHEN c.product_code IS NOT NULL THEN DATE '{DAYS[6]}' END AS expired_date,
          c.product_code IS NULL AS flag
        FROM old_dim o LEFT JOIN changed c ON c.product_code = o.product_code AND c.seller_id = o.seller_id"""
    ),
)
def expired_versions(spark: SparkSession, sf: str) -> DataFrame:
    dim = dim_after(spark, sf, 1)
    keys = _written(joins.changed_products(image_with_ids(spark, sf, 6), dim), "changed")
    return scd.expire_versions(dim, keys, DAYS[6]).select("product_id", "expired_date", "flag")


@check(
    "PIP-6 SET-2",
    over_star(
        f"""{_VERSIONED}, added AS (SELECT * FROM fresh UNION ALL SELECT * FROM changed)
        SELECT o.product_id, o.product_code, o.seller_id, o.sold, o.effective_date,
          CASE WHEN c.product_code IS NOT NULL THEN DATE '{DAYS[6]}' END AS expired_date,
          c.product_code IS NULL AS flag
        FROM old_dim o LEFT JOIN changed c ON c.product_code = o.product_code AND c.seller_id = o.seller_id
        UNION ALL
        SELECT (SELECT max(product_id) FROM old_dim) + row_number() OVER (ORDER BY {_DIGEST}), product_code, seller_id,
          sold, effective_date, expired_date, flag FROM added"""
    ),
)
def upserted_products(spark: SparkSession, sf: str) -> DataFrame:
    dim = dim_after(spark, sf, 1)
    changes = _written(scd.product_changes(dim, image_with_ids(spark, sf, 6)), "changes")
    merged = scd.apply_changes(dim, changes, DAYS[6])
    return merged.select("product_id", "product_code", "seller_id", "sold", "effective_date", "expired_date", "flag")


@check(
    "JOI-8",
    over_star(
        """SELECT sale_id FROM fact_sales f WHERE date_id > 1 AND platform_id = 12 AND NOT EXISTS (
          SELECT 1 FROM fact_sales o WHERE o.date_id = 1 AND o.product_id = f.product_id)"""
    ),
)
def new_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Against a history in buckets of products and sellers, which is not shuffled."""
    warehouse = Warehouse(spark, scratch_path(spark, "bucketed")).create(buckets=8)
    sales = star.stored(spark, sf, "fact_sales")
    warehouse.add("fact_sales", lambda _: sales.where("date_id = 1"))
    later = sales.where("platform_id = 12 AND date_id > 1")
    history = warehouse.read("fact_sales").where("platform_id = 12")
    with colocated(spark):
        return _written(joins.new_facts(later, history, FACT_KEYS[12]).select("sale_id"), "new-facts")


@check(
    "JOI-9",
    over_star(
        """SELECT snapshot_id FROM fact_periodic_sales f WHERE NOT EXISTS (
          SELECT 1 FROM fact_periodic_sales o WHERE o.report_period = '30-DAY' AND o.product_id = f.product_id)"""
    ),
)
def new_growth_rows(spark: SparkSession, sf: str) -> DataFrame:
    table = star.stored(spark, sf, "fact_periodic_sales")
    return joins.new_periodic(table, table.where("report_period = '30-DAY'"), PERIODIC_KEYS).select("snapshot_id")


@check(
    "JOI-10",
    over_star(
        f"""WITH prev AS (SELECT * FROM fact_sales WHERE date_id < 6
          QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY date_id DESC) = 1)
        SELECT f.sale_id, p.units_sold AS prev_units_sold, p.total_sales_amount AS prev_total_sales_amount
        FROM fact_sales f LEFT JOIN prev p USING ({KEY}) WHERE f.date_id = 6"""
    ),
)
def facts_with_previous(spark: SparkSession, sf: str) -> DataFrame:
    sales = star.stored(spark, sf, "fact_sales")
    latest = windows.latest_per_key(sales.where("date_id < 6"), PRODUCT_KEY)
    joined = joins.with_previous(sales.where("date_id = 6"), latest)
    return joined.select("sale_id", "prev_units_sold", "prev_total_sales_amount")


@check(
    "JOI-11 SET-3",
    over_star("SELECT category_id, parent_id, level FROM dim_category WHERE category_code <> -1"),
)
def resolved_parents(spark: SparkSession, sf: str) -> DataFrame:
    tree = star.stored(spark, sf, "category_tree")
    with_ids = tree.withColumn("category_id", F.col("platform_id") * F.lit(REGION) + F.col("category_code"))
    return trees.resolve_parents(with_ids).select("category_id", "parent_id", "level")


@check(
    "JOI-12",
    over_star(
        f"""WITH latest AS (SELECT * FROM fact_sales QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY date_id DESC) = 1)
        SELECT f.sale_id, l.sale_id AS latest_sale_id, l.units_sold - f.units_sold AS grown
        FROM fact_sales f JOIN latest l USING ({KEY}) WHERE f.sale_id <> l.sale_id"""
    ),
)
def older_against_latest(spark: SparkSession, sf: str) -> DataFrame:
    pairs = joins.against_latest(star.stored(spark, sf, "fact_sales", alone=True), PRODUCT_KEY)
    grown = (F.col("latest_units_sold") - F.col("units_sold")).alias("grown")
    return pairs.select("sale_id", "latest_sale_id", grown)


@check(
    "JOI-17",
    "SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN"
    " (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
)
def nations_not_in_list(spark: SparkSession, sf: str) -> DataFrame:
    values = star.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    rich = star.table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return joins.not_in(values, rich, "nation")


# ---- loads ----


@check(
    "PIP-1 SNK-6 SCA-8 SCA-5",
    """SELECT 'date' AS kind, NULL::INT AS platform_id, d::VARCHAR AS name, year(d) * 10 + quarter(d) AS number
       FROM (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem)
    UNION ALL SELECT kind, platform_id, name, -1 FROM (VALUES (10), (11), (12)) p(platform_id),
      (VALUES ('category', 'Khác'), ('brand', 'No Brand'), ('seller', 'No Seller')) m(kind, name)
    UNION ALL SELECT 'location', NULL, 'Chưa rõ', -1""",
)
def seeded_members(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds the shipping days of large orders, then every shipping day over what the first run left."""
    warehouse = Warehouse(spark, scratch_path(spark, "seed")).create()
    sales = star.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    dimensions.seed(warehouse, sales.where("l_quantity > 45"))
    dimensions.seed(warehouse, sales)
    none = F.lit(None).cast("int").alias("platform_id")
    dates = warehouse.read("dim_date").select(
        F.lit("date").alias("kind"),
        none,
        F.col("date").cast("string").alias("name"),
        (F.col("year") * 10 + F.col("quarter")).cast("bigint").alias("number"),
    )
    members = [
        warehouse.read(f"dim_{what}").select(
            F.lit(what).alias("kind"),
            "platform_id",
            F.col(f"{what}_name").alias("name"),
            F.col(f"{what}_code").alias("number"),
        )
        for what in ("category", "brand", "seller")
    ]
    place = warehouse.read("dim_location").select(
        F.lit("location").alias("kind"), none, F.col("location_name").alias("name"), F.col("location_id").alias("number")
    )
    return union_all(dates, *members, place)


@check(
    "PIP-2 JOI-11 JOI-5",
    over_star(
        """SELECT c.category_code, c.platform_id, c.category_name, c.level, p.category_code AS parent_code
        FROM dim_category c LEFT JOIN dim_category p ON p.category_id = c.parent_id"""
    ),
)
def loaded_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The upper levels first, then the whole tree: only the rest is added, below known parents."""
    warehouse = Warehouse(spark, scratch_path(spark, "categories")).create()
    dimensions.seed(warehouse, DAYS[1])
    tree = star.stored(spark, sf, "category_tree")
    with staging(spark) as stage:
        dimensions.load_categories(warehouse, tree.where("level <= 1"), stage)
        dimensions.load_categories(warehouse, tree, stage)
    loaded = warehouse.read("dim_category")
    parents = loaded.select(F.col("category_id").alias("parent_id"), F.col("category_code").alias("parent_code"))
    return loaded.join(parents, "parent_id", "left").select(
        "category_code", "platform_id", "category_name", "level", "parent_code"
    )


@check(
    "PIP-3",
    over_star(
        f"""SELECT DISTINCT 'brand' AS kind, platform_id, p_brand AS name FROM listing
          WHERE platform_id > 10 AND p_size <> {NO_BRAND}
        UNION ALL SELECT DISTINCT 'seller', platform_id, s_name FROM listing WHERE platform_id > 10 AND p_size <> {NO_SELLER}
        UNION ALL SELECT DISTINCT 'location', 0, upper(n_name) FROM listing WHERE platform_id < 12"""
    ),
)
def loaded_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """All snapshots of each marketplace into brand, seller and location: the older ones, then the newest."""
    warehouse = Warehouse(spark, scratch_path(spark, "dims")).create()
    with staging(spark) as stage:
        for days in ((1, 2, 3, 4, 5), (6,)):
            for platform_id in (10, 11, 12):
                batch = union_all(*[_flat(spark, sf, platform_id, date_id) for date_id in days])
                dimensions.load_dims(warehouse, batch, platform_id, stage)
    coded = [
        warehouse.read(f"dim_{what}").select(F.lit(what).alias("kind"), "platform_id", F.col(f"{what}_name").alias("name"))
        for what in ("brand", "seller")
    ]
    places = warehouse.read("dim_location").select(
        F.lit("location").alias("kind"), F.lit(0).alias("platform_id"), F.col("location_name").alias("name")
    )
    return union_all(*coded, places)


@check(
    "PIP-4",
    over_star(f"SELECT row_number() OVER (ORDER BY {_DIGEST}) AS product_id, * FROM ({_id_image_sql(6)})"),
)
def loaded_products(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "products")
    warehouse = Warehouse(spark, root).create()
    warehouse.append("dim_seller", star.stored(spark, sf, "dim_seller"))
    with staging(spark) as stage:
        products.load_products(warehouse, _flat(spark, sf, 12, 6), 12, DAYS[6], stage)
    return warehouse.read("dim_product")


class _DimsWith:
    """Star-schema dimensions with another product table."""

    def __init__(self, spark: SparkSession, sf: str, dim_product: DataFrame) -> None:
        self._tables, self._product = star.tables(spark, sf), dim_product

    def __getitem__(self, name: str) -> DataFrame:
        return self._product if name == "dim_product" else self._tables[name]


_FACTS_12 = f"""WITH image AS ({_id_image_sql(6)}),
ids AS (SELECT row_number() OVER (ORDER BY {_DIGEST}) AS product_id, * FROM image),
codes AS (SELECT p_partkey::VARCHAR AS product_code, CASE WHEN p_size = {NO_SELLER} THEN -12 ELSE s_suppkey + 1 END AS seller_id,
    CASE WHEN p_size > {NO_CATEGORY} THEN 12 ELSE 12 * {REGION} + c3 END AS category_id,
    CASE WHEN p_size = {NO_BRAND} THEN 12 ELSE 12 * 100000 + brand_code END AS brand_id
  FROM listing WHERE platform_id = 12 AND date_id = 6)"""


@check(
    "PIP-5 JOI-4",
    over_star(
        f"""{_FACTS_12} SELECT DISTINCT 6::BIGINT AS date_id, 12 AS platform_id, category_id, brand_id, seller_id, product_id,
          product_code, -1::BIGINT AS location_id, sold AS units_sold, (sold * price)::DECIMAL(38,2) AS total_sales_amount
        FROM codes JOIN ids USING (product_code, seller_id)"""
    ),
)
def built_facts_p12(spark: SparkSession, sf: str) -> DataFrame:
    dims = _DimsWith(spark, sf, dim_after(spark, sf, 6))
    return facts.build_facts(_flat(spark, sf, 12, 6), dims, 12, F.lit(6))


def _short_facts(spark: SparkSession, sf: str, platform_id: int) -> DataFrame:
    """Facts of a marketplace over a first product load."""
    warehouse = Warehouse(spark, scratch_path(spark, "facts")).create()
    warehouse.append("dim_seller", star.stored(spark, sf, "dim_seller"))
    rows = _flat(spark, sf, platform_id, 6)
    with staging(spark) as stage:
        products.load_products(warehouse, rows, platform_id, DAYS[6], stage)
    built = facts.build_facts(rows, _DimsWith(spark, sf, warehouse.read("dim_product")), platform_id, F.lit(6))
    return built.select(
        "product_code", "seller_id", "category_id", "brand_id", "location_id", "units_sold", "total_sales_amount"
    )


@check(
    "PIP-5 JOI-1 JOI-3",
    over_star(
        f"""WITH image AS ({image_sql(11, 6)}),
        codes AS (SELECT v.prefix || p_partkey AS product_code,
            CASE WHEN p_size = {NO_SELLER} THEN -1 ELSE s_suppkey END AS seller_code,
            CASE WHEN p_size > {NO_CATEGORY} THEN 11 ELSE 11 * {REGION} + c3 END AS category_id,
            CASE WHEN p_size = {NO_BRAND} THEN 11 ELSE 11 * 100000 + brand_code END AS brand_id, n_name
          FROM listing, (VALUES (''), ('v')) v(prefix) WHERE platform_id = 11 AND date_id = 6)
        SELECT c.product_code, CASE WHEN seller_code = -1 THEN -11 ELSE seller_code + 1 END AS seller_id, category_id,
          brand_id, n_nationkey::BIGINT AS location_id, sold AS units_sold,
          (sold * price)::DECIMAL(38,2) AS total_sales_amount
        FROM codes c JOIN image i USING (product_code, seller_code) JOIN nation n USING (n_name)
        QUALIFY row_number() OVER (PARTITION BY c.product_code, seller_code ORDER BY category_id, brand_id, n_nationkey) = 1"""
    ),
)
def built_facts_p11(spark: SparkSession, sf: str) -> DataFrame:
    return _short_facts(spark, sf, 11)


@check(
    "PIP-5 SCA-17",
    over_star(
        f"""WITH image AS ({image_sql(10, 6)}),
        codes AS (SELECT p_partkey::VARCHAR AS product_code, n_name,
            CASE WHEN p_size > {NO_CATEGORY} THEN 10 ELSE 10 * {REGION} + c1 END AS category_id
          FROM listing WHERE platform_id = 10 AND date_id = 6 AND p_size <> 7)
        SELECT c.product_code, -10::BIGINT AS seller_id, category_id, 10::BIGINT AS brand_id,
          n_nationkey::BIGINT AS location_id, sold AS units_sold, (sold * price)::DECIMAL(38,2) AS total_sales_amount
        FROM codes c JOIN image i USING (product_code) JOIN nation n USING (n_name)
        QUALIFY row_number() OVER (PARTITION BY c.product_code ORDER BY category_id, n_nationkey) = 1"""
    ),
)
def built_facts_p10(spark: SparkSession, sf: str) -> DataFrame:
    return _short_facts(spark, sf, 10)


@check(
    "PIP-8 SCA-19",
    over_star(
        f"""WITH prev AS (SELECT * FROM fact_sales WHERE date_id < 6
          QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY date_id DESC) = 1),
        image AS (SELECT * REPLACE (product_id + 1 AS product_id, units_sold + 2 AS units_sold) FROM fact_sales
          WHERE date_id = 6 AND platform_id = 12)
        SELECT i.product_id, i.units_sold, CASE WHEN p.sale_id IS NULL THEN i.total_sales_amount
          ELSE round(p.total_sales_amount + (i.units_sold - p.units_sold)
            * round((i.total_sales_amount / i.units_sold)::DECIMAL(38,10), 6), 2) END::DECIMAL(38,2) AS total_sales_amount
        FROM image i LEFT JOIN prev p USING ({KEY})
        WHERE NOT EXISTS (SELECT 1 FROM fact_sales o WHERE o.product_id = i.product_id AND o.date_id < 6
          AND o.category_id = i.category_id AND o.brand_id = i.brand_id AND o.seller_id = i.seller_id
          AND o.location_id = i.location_id)"""
    ),
)
def adjusted_fact_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Newest snapshot as new product versions with two more units, against the older snapshots."""
    sales = star.stored(spark, sf, "fact_sales").where("platform_id = 12")
    image = sales.where("date_id = 6").withColumns(
        {"product_id": F.col("product_id") + 1, "units_sold": F.col("units_sold") + 2}
    )
    older = sales.where("date_id < 6")
    delta = facts.fact_delta(image.select(*facts.FACT_COLUMNS), older, FACT_KEYS[12], stage=_written)
    return delta.select("product_id", "units_sold", "total_sales_amount")


_GROWTH = ", ".join(growth.GROWTH_COLUMNS)


@check(
    "PIP-9 SCA-6 SCA-7 JOI-16 AGG-3",
    over_star(f"SELECT {_GROWTH} FROM fact_periodic_sales WHERE platform_id = 12"),
)
def growth_per_period(spark: SparkSession, sf: str) -> DataFrame:
    return growth.growth(star.stored(spark, sf, "fact_sales"), star.stored(spark, sf, "dim_date"), 12)


# ---- whole loads ----

# What the loads of all snapshots of all marketplaces leave. A product row is stored when its counter changed; a
# sales row when the version or, where several sellers share one listing, its place was not stored yet.
# Places have ids in the order in which the loads bring them, and within a load by digest.


def _stored_sql(load_order: str) -> str:
    images = " UNION ALL ".join(
        f"SELECT {i} AS load, platform_id, product_code, seller_code, sold, price, effective_date FROM ({image_sql(p, i)})"
        for p in PLATFORMS
        for i in DAYS
    )
    return f"""WITH images AS MATERIALIZED ({images}),
    counted AS (SELECT *, lag(sold) OVER (PARTITION BY platform_id, product_code, seller_code ORDER BY load) AS before FROM images),
    versions AS (SELECT *, sum((before IS NULL OR sold <> before)::INT)
      OVER (PARTITION BY platform_id, product_code, seller_code ORDER BY load) AS version FROM counted),
    offers AS MATERIALIZED (
      SELECT date_id AS load, platform_id, v.prefix || p_partkey AS product_code, upper(n_name) AS place,
        CASE WHEN platform_id = 10 OR p_size = {NO_SELLER} THEN -1 ELSE s_suppkey END AS seller_code
      FROM listing JOIN (VALUES (10, ''), (11, ''), (11, 'v'), (12, '')) v(p, prefix) ON platform_id = v.p
      WHERE platform_id <> 10 OR p_size <> 7),
    places AS (
      SELECT place, min({load_order}) AS came FROM offers WHERE platform_id < 12 GROUP BY place),
    ranked AS (SELECT place, row_number() OVER (ORDER BY came, md5(place)) AS rank FROM places),
    placed AS (
      SELECT load, platform_id, product_code, seller_code,
        CASE WHEN platform_id = 12 THEN 'Chưa rõ' ELSE min_by(place, rank) END AS place
      FROM offers LEFT JOIN ranked USING (place) GROUP BY load, platform_id, product_code, seller_code),
    stored AS MATERIALIZED (
      SELECT * FROM versions JOIN placed USING (load, platform_id, product_code, seller_code)
      QUALIFY load = min(load) OVER (PARTITION BY platform_id, product_code, seller_code, version, place))"""


_IN_TURN = "load * 100 + platform_id"
_BY_MARKETPLACE = "platform_id * 100 + load"


def _facts_sql(load_order: str) -> str:
    return f"""{_stored_sql(load_order)}
    SELECT platform_id, product_code, seller_code, place, effective_date AS date, sold AS units_sold,
      (sold * price)::DECIMAL(38,2) AS total_sales_amount FROM stored"""


def _tree(spark: SparkSession, sf: str, platform_id: int) -> DataFrame | None:
    return star.stored(spark, sf, "category_tree").where(F.col("platform_id") == platform_id) if platform_id != 10 else None


def land_snapshots(spark: SparkSession, sf: str, platform_id: int, folder: str, days: Iterable[int] = DAYS) -> None:
    """The dated landing files of a marketplace, in the form in which it delivers them."""
    write = write_arrays if platform_id in MULTILINE_LANDING else write_chunks
    for date_id in days:
        write(landing.landing(spark, sf, platform_id, date_id), folder, "details", DAYS[date_id], 100_000, compressed=True)


class Turns:
    """A fixed order in which marketplaces, loaded side by side, do a step; one that ends gives up its other turns."""

    def __init__(self, order: Sequence[int]) -> None:
        self._order, self._changed = list(order), threading.Condition()

    @contextmanager
    def of(self, platform_id: int) -> Iterator[None]:
        with self._changed:
            self._changed.wait_for(lambda: platform_id not in self._order or self._order[0] == platform_id)
        yield
        with self._changed:
            if platform_id in self._order:
                self._order.remove(platform_id)
            self._changed.notify_all()

    def end(self, platform_id: int) -> None:
        with self._changed:
            self._order = [other for other in self._order if other != platform_id]
            self._changed.notify_all()


def _side_by_side(turns: Turns, run: Callable[[int], None]) -> None:
    def one(platform_id: int) -> None:
        try:
            run(platform_id)
        finally:
            turns.end(platform_id)

    with ThreadPoolExecutor(len(PLATFORMS)) as pool:
        for part in [pool.submit(one, p) for p in PLATFORMS]:
            part.result()


_loaded: dict[tuple[str, str], Warehouse] = {}


def loaded_warehouse(spark: SparkSession, sf: str) -> Warehouse:
    """A warehouse after the first and all later loads of each marketplace, made once per application.

    Each load takes the newest dated files of its landing folder, while the next ones are landed. The marketplaces
    are loaded side by side; P10 and P11, which bring places, take turns in adding them.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key in _loaded:
        return _loaded[key]
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse")).create()
    dimensions.seed(warehouse, DAYS[1])
    folders = {p: scratch_path(spark, f"landing-{p}") for p in PLATFORMS}

    turns = Turns([p for _ in DAYS for p in (10, 11)])

    def run(p: int) -> None:
        with ThreadPoolExecutor(1) as crawl:
            for date_id in DAYS:
                if date_id == 1:
                    land_snapshots(spark, sf, p, folders[p], [date_id])
                else:
                    landed.result()
                batch, day = latest_batch(spark, folders[p], "details", landing.LANDING[p], p in MULTILINE_LANDING)
                landed = crawl.submit(land_snapshots, spark, sf, p, folders[p], [date_id + 1] if date_id + 1 in DAYS else [])
                load = incremental.run_initial if date_id == 1 else incremental.run_incremental
                load(warehouse, batch, p, day, _tree(spark, sf, p), turns.of(p))

    for name in ("sold_pairs", "category_tree"):
        star.stored(spark, sf, name)
    _side_by_side(turns, run)
    _loaded[key] = warehouse
    return warehouse


def _loaded_facts(warehouse: Warehouse, name: str, *more: str) -> DataFrame:
    rows = warehouse.read(name).join(warehouse.read("dim_date").select("date_id", "date"), "date_id")
    rows = rows.join(warehouse.read("dim_seller").select("seller_id", "seller_code"), "seller_id")
    places = warehouse.read("dim_location").select("location_id", F.col("location_name").alias("place"))
    return rows.join(places, "location_id").select(
        "platform_id", "product_code", "seller_code", "place", "date", "units_sold", "total_sales_amount", *more
    )


@check("PIP-7 SRC-1 SRC-7 SNK-1 SNK-2", over_star(_facts_sql(_IN_TURN)))
def incremental_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Sales rows after the loads of all six snapshots of the three marketplaces."""
    return _loaded_facts(loaded_warehouse(spark, sf), "fact_sales")


@check(
    "PIP-7 JOI-13",
    over_star(
        f"""{_stored_sql(_IN_TURN)}
        SELECT platform_id, product_code, seller_code, place, effective_date AS date, sold AS units_sold,
          (sold * price)::DECIMAL(38,2) AS total_sales_amount FROM stored
        QUALIFY load = max(load) OVER (PARTITION BY platform_id, product_code, seller_code)"""
    ),
)
def kept_latest_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The latest sales row of every product, as the loads have kept it from each delta."""
    warehouse = loaded_warehouse(spark, sf)
    held = latest_facts(warehouse, "fact_sales")

    class Kept:
        def read(self, name: str) -> DataFrame:
            return held if name == "fact_sales" else warehouse.read(name)

    return _loaded_facts(Kept(), "fact_sales")


@check("STR-1 PIP-7 SRC-2", over_star(_facts_sql(_BY_MARKETPLACE)))
def streamed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The same snapshots, taken up by one run of the file stream for each marketplace."""
    warehouse = Warehouse(spark, scratch_path(spark, "streamed")).create()
    dimensions.seed(warehouse, DAYS[1])
    for name in ("sold_pairs", "category_tree"):
        star.stored(spark, sf, name)

    turns = Turns([10, 11])

    def run(p: int) -> None:
        folder, checkpoint = scratch_path(spark, f"landing-{p}"), scratch_path(spark, f"checkpoint-{p}")
        land_snapshots(spark, sf, p, folder)
        tree, places = _tree(spark, sf, p), turns.of(p)
        run_incremental_stream(warehouse, folder, checkpoint, p, "details", tree, places=places).awaitTermination()

    _side_by_side(turns, run)
    return _loaded_facts(warehouse, "fact_sales")


@check(
    "PIP-7 PIP-9 JOI-9",
    over_star(
        f"""{_stored_sql(_IN_TURN)}, amounts AS (SELECT *, (sold * price)::DECIMAL(38,2) AS amount FROM stored)
        SELECT platform_id, product_code, seller_code, now.place, now.effective_date AS date, now.sold - past.sold AS units_sold,
          (now.amount - past.amount)::DECIMAL(38,2) AS total_sales_amount,
          coalesce((SELECT min(d)::VARCHAR FROM (VALUES (7), (14), (21), (30)) g(d)
            WHERE d >= now.effective_date - past.effective_date), '60') || '-DAY' AS report_period
        FROM amounts now JOIN amounts past USING (platform_id, product_code, seller_code)
        WHERE past.load < now.load AND now.sold > past.sold AND now.amount > past.amount"""
    ),
)
def incremental_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Growth rows that the loads of all snapshots have added."""
    return _loaded_facts(loaded_warehouse(spark, sf), "fact_periodic_sales", "report_period")
