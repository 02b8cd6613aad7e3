"""A marketplace star schema laid over the test tables, for Spark and for the oracle.

The tables are derived by Spark and written to the shared folder, as a load would leave them; queries
read them from there. Line items are sales of a part (product) by a supplier (seller). The quantity sold up to six cut-off
days plays the all-time counter of six snapshots; a product is listed in a snapshot when its last sale
is at most LISTED_DAYS old.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators.skew import join_large, spread
from tradewind.operators.windows import latest_rows
from tradewind.plans.dimensions import unknown_members
from tradewind.schemas import PLATFORMS, PRODUCT_KEY
from tradewind.session import scratch_path
from tradewind.sinks.tables import append_table
from tradewind.sources.tables import read_table, rows_to_df

CUTOFFS = [
    (1, "2001-08-15"),
    (2, "2001-10-01"),
    (3, "2001-10-10"),
    (4, "2001-10-17"),
    (5, "2001-10-24"),
    (6, "2001-10-31"),
]
LISTED_DAYS = 1000
PAIR = 100_000_000
REGION = 10_000_000_000


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def platform_of(seller: Column) -> Column:
    return (F.lit(10) + seller % 3).cast("int")


def type_code() -> Column:
    """Number of a part type, from its spelling."""
    return F.ascii("p_type").cast("bigint") * 100 + F.length("p_type")


def _category_codes() -> list[Column]:
    first = type_code()
    second = first * 10 + F.col("p_size") % 5
    third = second * 100 + F.col("p_size")
    return [first, second, third, third * 1000 + F.ascii("p_name")]


def brand_code() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")


def price() -> Column:
    area = (F.col("p_size") * F.col("p_size")).cast("decimal(10,0)")
    return (F.col("p_retailprice").cast("decimal(10,2)") * area * F.lit(2)).cast("decimal(15,2)")


def original_price() -> Column:
    area = (F.col("p_size") * F.col("p_size")).cast("decimal(10,0)")
    return (F.col("p_retailprice").cast("decimal(10,2)") * area * F.lit(3)).cast("decimal(15,2)")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product and seller with the counter at every cut-off, from one aggregation.

    Few line items share a pair, so the narrow items are shuffled instead of all their counters. A task's counters take
    many times the bytes of its items, so the items go to as many tasks as their size calls for.
    """
    day = F.col("l_shipdate").cast("date")
    units = F.col("l_quantity").cast("bigint")
    measures = []
    for date_id, text in CUTOFFS:
        sold = day <= F.lit(text).cast("date")
        measures += [F.sum(F.when(sold, units)).alias(f"u{date_id}"), F.max(F.when(sold, day)).alias(f"d{date_id}")]
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return (
        spread(items, ["l_partkey", "l_suppkey"])
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum(units).alias("sold"), *measures)
        .withColumnsRenamed({"l_partkey": "p_partkey", "l_suppkey": "s_suppkey"})
    )


def described_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return join_large(pairs(spark, sf_dir), part, ["p_partkey"], "inner", profile=items)


def product_columns() -> dict[str, Column]:
    return {
        "product_id": F.col("s_suppkey") * PAIR + F.col("p_partkey") + 1,
        "product_code": F.col("p_partkey").cast("string"),
        "product_name": F.col("p_name"),
        "product_description": F.concat_ws(" ", "p_type", "p_brand"),
        "product_image": F.concat(F.lit("https://img.example.com/"), F.col("p_partkey"), F.lit(".jpg")),
        "product_url": F.concat(
            F.lit("https://shop.example.com/"),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
            F.lit("-i."),
            F.col("s_suppkey"),
            F.lit("."),
            F.col("p_partkey"),
            F.lit("?sp=1"),
        ),
        "price": F.col("price"),
        "original_price": F.col("original_price"),
        "discount_rate": (F.col("p_size").cast("decimal(5,2)") * F.lit("0.01").cast("decimal(5,2)")).cast(
            "decimal(5,2)"
        ),
        "rating_score": (F.col("p_size") % 6).cast("decimal(5,2)"),
        "review_count": (F.col("p_size") * 10).cast("int"),
        "seller_id": F.col("s_suppkey") + 1,
        "sold": F.col("sold"),
        "effective_date": F.lit(CUTOFFS[0][1]).cast("date"),
        "flag": F.col("p_size") > 5,
        "platform_id": platform_of(F.col("s_suppkey")),
        "expired_date": F.when(F.col("p_size") <= 5, F.lit(CUTOFFS[-1][1]).cast("date")),
    }


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir, "sold_pairs")
    return rows.select(*[c.alias(n) for n, c in product_columns().items()])


def _platforms() -> Column:
    return F.explode(F.array(*[F.lit(p) for p in PLATFORMS])).alias("platform_id")


def dim_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_to_df(spark, list(PLATFORMS.items()), "platform_id int, platform_name string")


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = rows_to_df(spark, CUTOFFS, "date_id bigint, day string")
    date = F.col("day").cast("date")
    return days.select(
        "date_id",
        date.alias("date"),
        F.day(date).alias("day"),
        F.month(date).alias("month"),
        F.year(date).alias("year"),
        F.quarter(date).alias("quarter"),
    )


def dim_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = rows_to_df(spark, [(-1, "Chưa rõ")], "location_id bigint, location_name string")
    places = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("location_id"), F.col("n_name").alias("location_name")
    )
    return places.unionByName(unknown)


def _with_unknown(spark: SparkSession, name: str, id_col: str, members: DataFrame, own_id: Column) -> DataFrame:
    unknown = unknown_members(dim_platform(spark, "").select("platform_id"))[name]
    return members.unionByName(unknown.withColumn(id_col, own_id.cast("bigint")))


def dim_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1).alias("seller_id"),
        F.col("s_suppkey").alias("seller_code"),
        F.col("s_name").alias("seller_name"),
        F.concat(F.lit("https://seller.example.com/"), F.col("s_suppkey")).alias("seller_url"),
        platform_of(F.col("s_suppkey")).alias("platform_id"),
    )
    return _with_unknown(spark, "dim_seller", "seller_id", members, -F.col("platform_id"))


def dim_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    code = brand_code()
    members = brands.select(code.alias("brand_code"), F.col("p_brand").alias("brand_name"), _platforms()).select(
        (F.col("platform_id") * 100_000 + F.col("brand_code")).alias("brand_id"),
        "brand_code",
        "brand_name",
        "platform_id",
    )
    return _with_unknown(spark, "dim_brand", "brand_id", members, F.col("platform_id"))


def _category_names() -> list[Column]:
    kind, size, letter = F.col("p_type"), F.col("p_size"), F.substring("p_name", 1, 1)
    return [
        kind,
        F.concat_ws(" ", kind, (size % 5).cast("string")),
        F.concat_ws(" ", kind, (size % 5).cast("string"), size.cast("string")),
        F.concat_ws(" ", kind, (size % 5).cast("string"), size.cast("string"), letter),
    ]


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels from type, size group, size and first letter, per platform, with parent codes."""
    codes, names = _category_codes(), _category_names()
    parents = [F.lit(-1).cast("bigint"), *codes[:-1]]
    nodes = F.array(
        *[
            F.struct(
                c.cast("bigint").alias("category_code"),
                n.alias("category_name"),
                p.cast("bigint").alias("parent_code"),
                F.lit(level).alias("level"),
            )
            for level, (c, n, p) in enumerate(zip(codes, names, parents, strict=True))
        ]
    )
    part = table(spark, sf_dir, "part")
    rows = part.select(F.explode(nodes).alias("n")).select("n.*").distinct()
    return rows.select(
        "category_code",
        _platforms(),
        "category_name",
        F.concat(F.lit("https://c.example.com/"), F.col("category_code")).alias("category_url"),
        "parent_code",
        "level",
    )


def dim_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("platform_id") * F.lit(REGION)
    members = category_tree(spark, sf_dir).select(
        (base + F.col("category_code")).alias("category_id"),
        "category_code",
        "platform_id",
        "category_name",
        "category_url",
        F.when(F.col("level") > 0, base + F.col("parent_code")).alias("parent_id"),
        "level",
    )
    return _with_unknown(spark, "dim_category", "category_id", members, F.col("platform_id"))


def listed(date_id: int, day: str) -> Column:
    return F.datediff(F.lit(day).cast("date"), F.col(f"d{date_id}")) <= LISTED_DAYS


def _fact_ids() -> dict[str, Column]:
    platform = F.col("platform_id")
    return {
        "category_id": platform * F.lit(REGION) + F.col("c3"),
        "brand_id": (platform * 100_000 + F.col("brand_code")),
        "seller_id": F.col("s_suppkey") + 1,
        "product_id": F.col("s_suppkey") * PAIR + F.col("p_partkey") + 1,
        "product_code": F.col("p_partkey").cast("string"),
        "location_id": F.col("n_nationkey").cast("bigint"),
        "platform_id": platform,
    }


def fact_sales(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One row per product and snapshot that lists it, from the stored pairs or from those given."""
    snapshots = F.array(
        *[
            F.when(
                listed(i, day),
                F.struct(F.lit(i).cast("bigint").alias("date_id"), F.col(f"u{i}").alias("units_sold")),
            )
            for i, day in CUTOFFS
        ]
    )
    rows = stored(spark, sf_dir, "sold_pairs") if rows is None else rows
    flat = rows.select(
        *[c.alias(n) for n, c in _fact_ids().items()],
        F.col("price").alias("_price"),
        F.explode(snapshots).alias("s"),
    )
    return flat.where("s IS NOT NULL").select(
        (F.col("product_id") * 10 + F.col("s.date_id")).alias("sale_id"),
        "s.date_id",
        "category_id",
        "brand_id",
        "seller_id",
        "product_id",
        "product_code",
        "location_id",
        "s.units_sold",
        (F.col("s.units_sold").cast("decimal(20,0)") * F.col("_price")).cast("decimal(38,2)").alias(
            "total_sales_amount"
        ),
        "platform_id",
    )


def fact_periodic_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth rows by conditional columns: the last snapshot against each earlier one."""
    last_id, last_day = CUTOFFS[-1]
    gaps = {1: "60-DAY", 2: "30-DAY", 3: "21-DAY", 4: "14-DAY", 5: "7-DAY"}
    growths = F.array(
        *[
            F.when(
                listed(i, day) & listed(last_id, last_day) & (F.col(f"u{last_id}") > F.col(f"u{i}")),
                F.struct(
                    F.lit(i).alias("from_id"),
                    (F.col(f"u{last_id}") - F.col(f"u{i}")).alias("units_sold"),
                    F.lit(gaps[i]).alias("report_period"),
                ),
            )
            for i, day in CUTOFFS[:-1]
        ]
    )
    rows = stored(spark, sf_dir, "sold_pairs").withColumn("g", F.explode(growths)).where("g IS NOT NULL")
    ids = _fact_ids()
    return rows.select(
        (ids["product_id"] * 10 + F.col("g.from_id")).alias("snapshot_id"),
        F.lit(last_id).cast("bigint").alias("date_id"),
        *[c.alias(n) for n, c in ids.items()],
        "g.units_sold",
        (F.col("g.units_sold").cast("decimal(20,0)") * F.col("price")).cast("decimal(38,2)").alias(
            "total_sales_amount"
        ),
        "g.report_period",
    )


def latest_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sales rows of every product: what the folds of the snapshots leave."""
    return latest_rows(stored(spark, sf_dir, "fact_sales"), PRODUCT_KEY)


def latest_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(stored(spark, sf_dir, "fact_periodic_sales"), PRODUCT_KEY)


def sold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their seller, place and counters: what a crawl would see."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = join_large(described_pairs(spark, sf_dir), supplier, ["s_suppkey"], "inner")
    return join_large(rows, nation, ["n_nationkey"], "inner").select(
        *rows.columns,
        "n_name",
        price().alias("price"),
        original_price().alias("original_price"),
        brand_code().alias("brand_code"),
        *[c.cast("bigint").alias(f"c{i}") for i, c in enumerate(_category_codes())],
        platform_of(F.col("s_suppkey")).alias("platform_id"),
    )


BUILDERS = {
    "sold_pairs": sold_pairs,
    "dim_platform": dim_platform,
    "dim_date": dim_date,
    "dim_location": dim_location,
    "dim_seller": dim_seller,
    "dim_brand": dim_brand,
    "category_tree": category_tree,
    "dim_category": dim_category,
    "dim_product": dim_product,
    "fact_sales": fact_sales,
    "fact_periodic_sales": fact_periodic_sales,
    "latest_sales": latest_sales,
    "latest_growth": latest_growth,
}


_roots: dict[tuple[str, str], str] = {}
_written: set[str] = set()


def stored(spark: SparkSession, sf_dir: str, name: str, alone: bool = False) -> DataFrame:
    """A star-schema table as a warehouse holds it: written once per application, then only read.

    `alone` says that the caller needs no other table made from the pairs: the sales are then written by the run that
    counts the pairs, which are not written themselves.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    root = _roots.setdefault(key, scratch_path(spark, "star"))
    if f"{root}/{name}" not in _written:
        if alone and name == "fact_sales" and f"{root}/sold_pairs" not in _written:
            rows = fact_sales(spark, sf_dir, sold_pairs(spark, sf_dir))
        else:
            rows = BUILDERS[name](spark, sf_dir)
        append_table(rows, name, root)
        _written.add(f"{root}/{name}")
    return read_table(spark, name, root)


class Tables(Mapping):
    """The star schema by table name; a table is written when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return stored(self.spark, self.sf_dir, name)

    def __iter__(self):
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)


def tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return Tables(spark, sf_dir)


_CUTOFF_ROWS = ", ".join(f"({i}::BIGINT, DATE '{day}')" for i, day in CUTOFFS)
_PLATFORM_ROWS = ", ".join(f"({p}, '{name}')" for p, name in PLATFORMS.items())

STAR_SQL = f"""
WITH RECURSIVE dim_platform AS (SELECT * FROM (VALUES {_PLATFORM_ROWS}) t(platform_id, platform_name)),
dim_date AS (
  SELECT date_id, date, day(date)::INT AS day, month(date)::INT AS month, year(date)::INT AS year,
         quarter(date)::INT AS quarter
  FROM (VALUES {_CUTOFF_ROWS}) t(date_id, date)),
dim_location AS (
  SELECT n_nationkey::BIGINT AS location_id, n_name AS location_name FROM nation UNION ALL SELECT -1, 'Chưa rõ'),
dim_seller AS (
  SELECT s_suppkey + 1 AS seller_id, s_suppkey AS seller_code, s_name AS seller_name,
         'https://seller.example.com/' || s_suppkey AS seller_url, (10 + s_suppkey % 3)::INT AS platform_id
  FROM supplier UNION ALL SELECT -platform_id, -1, 'No Seller', 'No url', platform_id FROM dim_platform),
dim_brand AS (
  SELECT platform_id * 100000 + replace(p_brand, 'Brand#', '')::BIGINT AS brand_id,
         replace(p_brand, 'Brand#', '')::BIGINT AS brand_code, p_brand AS brand_name, platform_id
  FROM (SELECT DISTINCT p_brand FROM part) b, dim_platform
  UNION ALL SELECT platform_id, -1, 'No Brand', platform_id FROM dim_platform),
coded_part AS MATERIALIZED (
  SELECT *, ascii(p_type)::BIGINT * 100 + length(p_type) AS c0,
         (ascii(p_type)::BIGINT * 100 + length(p_type)) * 10 + p_size % 5 AS c1,
         ((ascii(p_type)::BIGINT * 100 + length(p_type)) * 10 + p_size % 5) * 100 + p_size AS c2,
         (((ascii(p_type)::BIGINT * 100 + length(p_type)) * 10 + p_size % 5) * 100 + p_size) * 1000
           + ascii(p_name) AS c3,
         replace(p_brand, 'Brand#', '')::BIGINT AS brand_code,
         (p_retailprice::DECIMAL(10,2) * (p_size * p_size)::DECIMAL(10,0) * 2)::DECIMAL(15,2) AS price,
         (p_retailprice::DECIMAL(10,2) * (p_size * p_size)::DECIMAL(10,0) * 3)::DECIMAL(15,2) AS original_price
  FROM part),
category_tree AS MATERIALIZED (
  SELECT DISTINCT category_code, platform_id, category_name,
         'https://c.example.com/' || category_code AS category_url, parent_code, level
  FROM (SELECT c0 AS category_code, p_type AS category_name, -1::BIGINT AS parent_code, 0 AS level FROM coded_part
        UNION SELECT c1, p_type || ' ' || p_size % 5, c0, 1 FROM coded_part
        UNION SELECT c2, p_type || ' ' || p_size % 5 || ' ' || p_size, c1, 2 FROM coded_part
        UNION SELECT c3, p_type || ' ' || p_size % 5 || ' ' || p_size || ' ' || p_name[1], c2, 3 FROM coded_part) n,
       dim_platform),
dim_category AS (
  SELECT platform_id * {REGION} + category_code AS category_id, category_code, platform_id, category_name,
         category_url, CASE WHEN level > 0 THEN platform_id * {REGION} + parent_code END AS parent_id, level
  FROM category_tree
  UNION ALL SELECT platform_id, -1, platform_id, 'Khác', 'No url', NULL, 0 FROM dim_platform),
sold_pairs AS MATERIALIZED (
  SELECT l_partkey, l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS sold FROM lineitem GROUP BY ALL),
dim_product AS (
  SELECT l_suppkey * {PAIR} + p_partkey + 1 AS product_id, p_partkey::VARCHAR AS product_code,
         p_name AS product_name, p_type || ' ' || p_brand AS product_description,
         'https://img.example.com/' || p_partkey || '.jpg' AS product_image,
         'https://shop.example.com/' || replace(p_name, ' ', '-') || '-i.' || l_suppkey || '.' || p_partkey || '?sp=1'
           AS product_url,
         price, original_price, (p_size * 0.01::DECIMAL(5,2))::DECIMAL(5,2) AS discount_rate,
         (p_size % 6)::DECIMAL(5,2) AS rating_score, (p_size * 10)::INT AS review_count, l_suppkey + 1 AS seller_id,
         sold, DATE '{CUTOFFS[0][1]}' AS effective_date, p_size > 5 AS flag,
         (10 + l_suppkey % 3)::INT AS platform_id,
         CASE WHEN p_size <= 5 THEN DATE '{CUTOFFS[-1][1]}' END AS expired_date
  FROM sold_pairs JOIN coded_part ON p_partkey = l_partkey),
counters AS MATERIALIZED (
  SELECT date_id, date, l_partkey, l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS units_sold
  FROM lineitem JOIN dim_date ON l_shipdate::DATE <= date
  GROUP BY ALL HAVING date_diff('day', max(l_shipdate::DATE), date) <= {LISTED_DAYS}),
fact_sales AS MATERIALIZED (
  SELECT (l_suppkey * {PAIR} + p_partkey + 1) * 10 + date_id AS sale_id, date_id,
         (10 + l_suppkey % 3) * {REGION} + c3 AS category_id, (10 + l_suppkey % 3) * 100000 + brand_code AS brand_id,
         l_suppkey + 1 AS seller_id, l_suppkey * {PAIR} + p_partkey + 1 AS product_id,
         p_partkey::VARCHAR AS product_code, s_nationkey::BIGINT AS location_id, units_sold,
         (units_sold * price)::DECIMAL(38,2) AS total_sales_amount, (10 + l_suppkey % 3)::INT AS platform_id
  FROM counters JOIN coded_part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
listing AS MATERIALIZED (
  SELECT date_id, units_sold AS units, p.*, l_suppkey AS s_suppkey, s_name, n_name,
         (10 + l_suppkey % 3)::INT AS platform_id,
         'https://shop.example.com/' || replace(p_name, ' ', '-') || '-i.' || l_suppkey || '.' || p_partkey || '?sp=1'
           AS product_url
  FROM counters JOIN coded_part p ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey),
last_day AS MATERIALIZED (SELECT platform_id, max(date_id) AS date_id FROM fact_sales GROUP BY platform_id),
at_last AS MATERIALIZED (SELECT s.* FROM fact_sales s SEMI JOIN last_day d ON s.platform_id = d.platform_id AND s.date_id = d.date_id),
fact_periodic_sales AS MATERIALIZED (
  SELECT now.product_id * 10 + past.date_id AS snapshot_id, now.date_id, now.category_id, now.seller_id, now.product_id,
         now.product_code, now.brand_id, now.location_id, now.units_sold - past.units_sold AS units_sold,
         (now.total_sales_amount - past.total_sales_amount)::DECIMAL(38,2) AS total_sales_amount,
         coalesce((SELECT min_by(label, days) FROM (VALUES (7, '7-DAY'), (14, '14-DAY'), (21, '21-DAY'), (30, '30-DAY')) p(days, label)
                   WHERE days >= (SELECT max(date) FROM dim_date) - (SELECT date FROM dim_date d WHERE d.date_id = past.date_id)),
                  '60-DAY') AS report_period,
         now.platform_id
  FROM at_last now JOIN fact_sales past USING (product_id)
  WHERE past.date_id < now.date_id AND past.units_sold < now.units_sold)
"""


def over_star(body: str) -> str:
    """Oracle text over the star schema; the body may begin with further named parts."""
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"{STAR_SQL},\n{text[5:]}"
    return f"{STAR_SQL}\n{text}"
