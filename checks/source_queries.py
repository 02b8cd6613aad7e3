"""Readers, writers, payloads, pages and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import landing, star
from checks.landing import NO_BRAND, NO_CATEGORY, NO_SELLER, SOLD_SQL, sold_text
from checks.registry import check
from checks.star import CUTOFFS, over_star
from tradewind import functions as X
from tradewind.operators.skew import join_large
from tradewind.schemas import LANDING, PLATFORMS
from tradewind.session import scratch_path
from tradewind.sinks import files as file_sink
from tradewind.sinks import tables as table_sink
from tradewind.sinks.ledger import insert_if_absent
from tradewind.sources import landing as landing_source
from tradewind.sources import pages as page_source
from tradewind.sources import payloads, requests, storage
from tradewind.sources import tables as table_source

DAYS = dict(CUTOFFS)
_DAY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({date_id}, '{day}')" for date_id, day in CUTOFFS) + ") days(date_id, day)"


# ---- readers and writers of landing files ----


def _chunked(spark: SparkSession, sf: str, platform_id: int, kind: str, rows: int) -> str:
    folder = scratch_path(spark, "landing")
    for date_id, day in DAYS.items():
        file_sink.write_chunks(landing.landing(spark, sf, platform_id, date_id), folder, kind, day, rows, compressed=True)
    return folder


@check(
    "SRC-1 SNK-2",
    over_star(
        f"""SELECT date_id, p_partkey::VARCHAR AS product_id, CASE WHEN p_size <> {NO_SELLER} THEN s_suppkey END AS seller,
          units FROM listing WHERE platform_id = 12"""
    ),
)
def landing_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = _chunked(spark, sf, 12, "details", 1_000)
    rows = landing_source.with_file_date(landing_source.read_json(spark, folder, LANDING[12]))
    numbers = F.coalesce(*[F.when(F.col("file_date") == F.lit(day).cast("date"), date_id) for date_id, day in DAYS.items()])
    return rows.select(
        numbers.cast("bigint").alias("date_id"),
        "product_id",
        F.col("data.current_seller.id").alias("seller"),
        F.col("data.all_time_quantity_sold").alias("units"),
    )


@check(
    "SRC-2 SNK-2",
    over_star(
        """SELECT p_name AS title, CASE WHEN p_size > 25 THEN 'TP. ' ELSE '|' END || lower(n_name) AS location,
          p_type AS category, 1 AS offers FROM listing WHERE platform_id = 10 AND date_id = 6"""
    ),
)
def multiline_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-line arrays of records, read back."""
    folder = scratch_path(spark, "arrays")
    rows = landing.landing(spark, sf, 10, 6)
    file_sink.write_arrays(rows, folder, "products", DAYS[6], file_sink.CHUNK_ROWS[10])
    read = landing_source.read_json(spark, folder, LANDING[10], multiline=True)
    return read.select(
        "title", "location", F.col("category")[0].category_name.alias("category"), F.size("promotions").alias("offers")
    )


@check("SRC-6 SRT-6", over_star(f"SELECT max(day) AS day FROM listing JOIN ({_DAY_SQL}) USING (date_id) WHERE platform_id = 12"))
def most_recent_file(spark: SparkSession, sf: str) -> DataFrame:
    latest = landing_source.latest_file(spark, _chunked(spark, sf, 12, "details", 1_000_000), "details")
    return latest.select(F.regexp_extract("name", landing_source.FILE_DATE, 1).alias("day"))


@check(
    "SRC-7",
    over_star("SELECT p_partkey::VARCHAR AS product_id, units FROM listing WHERE platform_id = 12 AND date_id = 6"),
)
def newest_batch(spark: SparkSession, sf: str) -> DataFrame:
    folder = _chunked(spark, sf, 12, "details", 500)
    batch, _ = landing_source.latest_batch(spark, folder, "details", LANDING[12])
    return batch.select("product_id", F.col("data.all_time_quantity_sold").alias("units"))


@check(
    "SNK-2",
    over_star(
        f"""SELECT day, count(*) AS records, true AS within_limit, true AS enough_files
        FROM listing JOIN ({_DAY_SQL}) USING (date_id) WHERE platform_id = 11 GROUP BY day"""
    ),
)
def chunk_sizes(spark: SparkSession, sf: str) -> DataFrame:
    folder = _chunked(spark, sf, 11, "products", 50)
    per_file = (
        landing_source.read_json(spark, folder, LANDING[11])
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count("*").alias("n"))
    )
    day = F.regexp_extract("file", landing_source.FILE_DATE, 1).alias("day")
    return per_file.groupBy(day).agg(
        F.sum("n").alias("records"),
        (F.max("n") <= 50).alias("within_limit"),
        (F.count("*") >= F.ceil(F.sum("n") / 50)).alias("enough_files"),
    )


@check(
    "SNK-3",
    """SELECT url AS name, CASE WHEN url LIKE 'https:%' THEN 1 ELSE 2 END AS batch FROM pages
    WHERE url IS NOT NULL GROUP BY url""",
)
def files_to_land(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest after two batches, a repeated batch and a late copy of everything."""
    root = scratch_path(spark, "manifest")
    urls = star.table(spark, sf, "pages").where("url IS NOT NULL").select(F.col("url").alias("name"))
    secure = urls.where(F.col("name").startswith("https:"))
    for number, (files, token) in enumerate(((secure, "one"), (urls, "two"), (urls, "two"), (urls, None)), 1):
        file_sink.land_if_absent(files.withColumn("batch", F.lit(number)), root, token)
    return table_source.read_table(spark, "landed", root)


@check("SRT-6 SRC-6", over_star(f"SELECT max(day) AS day, count(DISTINCT day) AS batches FROM listing JOIN ({_DAY_SQL}) USING (date_id) WHERE platform_id = 11"))
def files_taken_up(spark: SparkSession, sf: str) -> DataFrame:
    """Landing files taken up in two goes: the second lists only what has come since, a third finds nothing."""
    folder, root = scratch_path(spark, "landing"), scratch_path(spark, "taken")
    names = []
    for days in ((1, 2, 3, 4), (5, 6), ()):
        for date_id in days:
            file_sink.write_chunks(landing.landing(spark, sf, 11, date_id), folder, "products", DAYS[date_id], 100_000, compressed=True)
        landing_source.take_up(spark, folder, "products", root)
        names.append(landing_source.files_by_time(landing_source.taken(spark, "products", root)).select("name", F.lit(len(days)).alias("days")))
    assert names[1].count() == names[2].count()
    day = F.regexp_extract("name", landing_source.FILE_DATE, 1)
    return names[2].agg(F.max(day).alias("day"), F.count_distinct(day).alias("batches"))


# ---- tables ----


@check("SRC-3", over_star("SELECT * FROM dim_seller"))
def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    return star.stored(spark, sf, "dim_seller")


@check(
    "SRC-4",
    """SELECT platform_id, platform_name, count(*)::BIGINT AS sellers FROM supplier,
      (VALUES (10, 'P10'), (11, 'P11'), (12, 'P12')) p(platform_id, platform_name)
    WHERE 10 + s_suppkey % 3 = platform_id GROUP BY ALL""",
)
def literal_rows(spark: SparkSession, sf: str) -> DataFrame:
    schema = "platform_id int, platform_name string"
    rows = table_source.rows_to_df(spark, list(PLATFORMS.items()), schema)
    empty = table_source.rows_to_df(spark, [], schema)
    platforms = rows.unionByName(empty)
    sellers = star.table(spark, sf, "supplier").select(star.platform_of(F.col("s_suppkey")).alias("platform_id"))
    joined = join_large(sellers, platforms, ["platform_id"], "inner")
    return joined.groupBy("platform_id", "platform_name").agg(F.count("*").alias("sellers"))


@check("SRC-5", "SELECT l_returnflag, sum(l_quantity::BIGINT)::BIGINT AS units FROM lineitem GROUP BY ALL")
def registered_view(spark: SparkSession, sf: str) -> DataFrame:
    view = table_source.as_view(star.table(spark, sf, "lineitem"), "sales")
    return spark.sql(f"SELECT l_returnflag, sum(cast(l_quantity AS bigint)) AS units FROM {view} GROUP BY l_returnflag")


@check(
    "SNK-1",
    over_star("SELECT sale_id, date_id, platform_id, units_sold FROM fact_sales"),
)
def appended_table(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "append")
    sales = star.stored(spark, sf, "fact_sales")
    for date_id in DAYS:
        table_sink.append_table(sales.where(F.col("date_id") == date_id), "fact_sales", root)
    return table_source.read_table(spark, "fact_sales", root).select("sale_id", "date_id", "platform_id", "units_sold")


@check("SNK-5", over_star("SELECT seller_id, upper(seller_name) || '!' AS seller_name FROM dim_seller"))
def swapped_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table rewritten from itself twice; readers go by the pointer that is written last."""
    root = scratch_path(spark, "swap")
    table_sink.append_table(star.stored(spark, sf, "dim_seller"), "dim_seller", root)
    for change in (F.upper("seller_name"), F.concat("seller_name", F.lit("!"))):
        current = table_source.read_table(spark, "dim_seller", root)
        table_sink.swap_table(current.withColumn("seller_name", change), "dim_seller", root)
    return table_source.read_table(spark, "dim_seller", root).select("seller_id", "seller_name")


@check(
    "SNK-5 SNK-4",
    over_star(
        """SELECT product_id, CASE WHEN platform_id = 12 AND expired_date IS NULL THEN sold + 1 ELSE sold END AS sold
        FROM dim_product"""
    ),
)
def replaced_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Open versions of one platform rewritten in place, the rest untouched."""
    root = scratch_path(spark, "partitions")
    table_sink.append_table(star.stored(spark, sf, "dim_product"), "dim_product", root)
    current = table_source.read_table(spark, "dim_product", root)
    open_rows = current.where("platform_id = 12 AND expired_date IS NULL")
    table_sink.replace_partitions(open_rows.withColumn("sold", F.col("sold") + 1), "dim_product", root)
    return table_source.read_table(spark, "dim_product", root).select("product_id", "sold")


@check("SNK-6", "SELECT p_brand AS brand_name, CASE WHEN max(p_size = 50) THEN 1 ELSE 2 END AS round FROM part GROUP BY p_brand")
def absent_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of large parts inserted first, then twice those of all parts: each is added once."""
    root = scratch_path(spark, "brands")
    part = star.table(spark, sf, "part")
    storage.make_dirs(spark, f"{root}/brands")
    for number, rows in enumerate((part.where("p_size = 50"), part, part), 1):
        brands = rows.select(F.col("p_brand").alias("brand_name")).distinct().withColumn("round", F.lit(number))
        insert_if_absent(brands, "brands", root, ["brand_name"])
    return table_source.read_table(spark, "brands", root)


# ---- pages ----


@check(
    "SRC-8",
    """WITH links AS (
      SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) AS href,
        unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) AS label,
        unnest(range(1, 1 + len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)))) AS position
      FROM pages)
    SELECT page_id, position::INT AS position,
      replace(replace(replace(href, '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS href,
      replace(replace(replace(label, '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS label, '' AS image FROM links""",
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"href": ("./a", "href"), "label": ("./a", None), "image": ("./img", "src")}
    return page_source.extract_pages(star.table(spark, sf, "pages"), ".//nav/ul/li", fields)


@check(
    "SRC-8",
    """SELECT page_id, 1 AS position, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
      regexp_extract(html, '<meta charset="([^"]+)"', 1) AS charset FROM pages""",
)
def page_heads(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"lang": (".", "lang"), "charset": ("./head/meta", "charset")}
    return page_source.extract_pages(star.table(spark, sf, "pages"), "./html", fields)


def _markup(tag: str, body: Column | str, attributes: str = "") -> Column:
    inner = F.lit(body) if isinstance(body, str) else body
    return F.concat(F.lit(f"<{tag}{attributes}>"), inner, F.lit(f"</{tag}>"))


@check(
    "SRC-8 PRJ-13",
    over_star(
        f"""SELECT p_name AS title, n_name AS location, units::VARCHAR || ' sold' AS sold, product_url AS url,
          p_type AS category, CASE WHEN p_size > {NO_CATEGORY} THEN '-1' ELSE c1::VARCHAR END AS sub_category,
          c0::VARCHAR AS parent, floor(price)::BIGINT::VARCHAR AS current_price, '' AS discount_rate
        FROM listing WHERE platform_id = 10 AND date_id = 6"""
    ),
)
def listing_page_records(spark: SparkSession, sf: str) -> DataFrame:
    """Saved listing pages, composed from the tables, back to landing records."""
    rows = landing.snapshot(spark, sf, 10, 6)
    text = _markup("div", _markup("div", _markup("div", F.col("p_name"))))
    current = _markup("div", F.concat(_markup("span", "a"), _markup("span", "b"), _markup("span", F.floor("price").cast("string"))))
    prices = _markup("div", F.concat(current, _markup("div", F.floor("original_price").cast("string"))))
    sold = _markup("div", F.concat(_markup("div", ""), _markup("div", F.concat(F.col("units"), F.lit(" sold")))))
    place = _markup("div", _markup("div", F.col("n_name"), " aria-label='from'"))
    card = _markup("div", F.concat(_markup("div", ""), _markup("div", F.concat(text, prices, sold, place))))
    item = F.concat(F.lit("<li><a href='"), landing._url(), F.lit("'>"), _markup("div", card), F.lit("</a></li>"))
    main_link = F.concat(F.lit("<a href='/cat."), F.col("c0"), F.lit("'>"), F.col("p_type"), F.lit("</a>"))
    main = _markup("div", main_link, f" class='{page_source.MAIN_CATEGORY_CLASS}'")
    sub_link = F.concat(
        F.lit(f"<a class='x {page_source.SUB_CATEGORY_CLASS}' href='/cat."), F.col("c0"), F.lit("."), F.col("c1"),
        F.lit("'>sub</a>"),
    )
    active = F.when(F.col("p_size") <= NO_CATEGORY, sub_link).otherwise("")
    items = _markup("ul", item, f" class='{page_source.ITEMS_CLASS}'")
    pages = rows.select(_markup("html", F.concat(main, active, items)).alias("html"))
    found = page_source.listing_pages(pages)
    return found.select(
        "title",
        "location",
        "sold",
        "url",
        F.col("category")[0].category_name.alias("category"),
        F.col("category")[1].category_id.alias("sub_category"),
        F.col("category")[1].parent_id.alias("parent"),
        "price.current_price",
        "price.discount_rate",
    )


# ---- page requests and payloads ----


@check(
    "SRC-9",
    """WITH n AS (SELECT l_orderkey, max(l_linenumber) AS max_page FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, 'https://shop.example.com/c?page=' || p || '&order=' || l_orderkey AS page_url
    FROM n, (SELECT unnest(range(0, 100)) AS p) WHERE p < max_page""",
)
def expanded_pages(spark: SparkSession, sf: str) -> DataFrame:
    orders = star.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    url = F.concat(F.lit("https://shop.example.com/c?page=0&order="), F.col("l_orderkey"))
    lines = orders.select("l_orderkey", F.concat_ws(",", url, F.col("n").cast("string")).alias("line"))
    listed = requests.split_page_line(lines, "line")
    return requests.expand_pages(listed, "url", "max_page").select("l_orderkey", "page_url")


@check(
    "SRC-10",
    """WITH n AS (SELECT o_custkey, floor(sum(o_totalprice) / 100000)::INT AS total FROM orders GROUP BY ALL),
      pages AS (SELECT o_custkey, unnest(range(1, ceil(total / 10.0)::INT + 1)) AS p FROM n)
    SELECT o_custkey, 'https://shop.example.com/k' || o_custkey || '/?page=' || p AS page_url FROM pages""",
)
def expanded_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = (
        star.table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.floor(F.sum("o_totalprice") / 100000).cast("int").alias("total"))
    )
    expanded = requests.expand_total(totals, "total", 10, "https://shop.example.com/k%d/?page=%d", ["o_custkey"])
    return expanded.select("o_custkey", "page_url")


@check(
    "SRC-10",
    """SELECT l_partkey, l_suppkey, 'https://shop.example.com/products/' || l_partkey || '?platform=web&spid='
      || l_suppkey AS url FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""",
)
def detail_urls(spark: SparkSession, sf: str) -> DataFrame:
    ids = star.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    template = "https://shop.example.com/products/%d?platform=web&spid=%d"
    return requests.detail_urls(ids, template, ["l_partkey", "l_suppkey"])


@check(
    "SRC-11",
    over_star(
        f"""SELECT p_partkey::VARCHAR AS product_id, CASE WHEN p_size <= {NO_CATEGORY} THEN c3::VARCHAR ELSE '' END
          AS category_id, '1.5' AS timestamp, p_name AS name, units AS sold,
          CASE WHEN p_size <> {NO_BRAND} THEN brand_code END AS brand
        FROM listing WHERE platform_id = 12 AND date_id = 6"""
    ),
)
def detail_payloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = landing.landing(spark, sf, 12, 6)
    category = F.when(F.col("category_id") != "", F.struct(F.col("category_id").alias("id")))
    bodies = rows.select(
        F.to_json(F.struct(F.col("product_id").alias("id"), category.alias("categories"), "data.*")).alias("body")
    )
    details = payloads.normalize_payload(bodies, "body", "detail", F.lit("1.5"))
    return details.select(
        "product_id",
        "category_id",
        "timestamp",
        F.col("data.name").alias("name"),
        F.col("data.all_time_quantity_sold").alias("sold"),
        F.col("data.brand.id").alias("brand"),
    )


@check(
    "SRC-11",
    """SELECT p_partkey::VARCHAR AS product_id, p_size::VARCHAR AS seller_product_id, '1.5' AS timestamp FROM part
    UNION ALL SELECT '', p_brand, '1.5' FROM part""",
)
def list_payloads(spark: SparkSession, sf: str) -> DataFrame:
    part = star.table(spark, sf, "part")
    full = F.struct(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("seller_product_id"))
    partial = F.struct(F.lit(None).cast("bigint").alias("id"), F.col("p_brand").alias("seller_product_id"))
    bodies = part.select(F.to_json(F.struct(F.array(full, partial).alias("data"))).alias("body"))
    return payloads.normalize_payload(bodies, "body", "list", F.lit("1.5"))


@check(
    "SRC-11",
    over_star(
        f"""SELECT CASE WHEN p_size = 7 THEN 0 ELSE 2 END AS items,
          CASE WHEN p_size <> 7 THEN p_partkey::VARCHAR END AS first_item,
          CASE WHEN p_size <= {NO_CATEGORY} THEN c3::VARCHAR ELSE 'none' END AS category
        FROM listing WHERE platform_id = 11 AND date_id = 6"""
    ),
)
def listing_payloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = landing.landing(spark, sf, 11, 6)
    missing = F.exists("products", lambda p: F.trim(p.review) == "70")
    mods = F.when(~missing, F.struct(F.col("products").alias("listItems")))
    bodies = rows.select(F.to_json(F.struct(mods.alias("mods"), F.col("main_info").alias("mainInfo"))).alias("body"))
    pages = payloads.normalize_payload(bodies, "body", "listing", F.lit(1.5))
    return pages.select(
        F.size("products").alias("items"),
        F.trim(X.item_at(F.col("products.itemId"), 1)).alias("first_item"),
        F.trim("main_info.trackParams.category").alias("category"),
    )


@check(
    "SRC-11",
    "SELECT props::JSON ->> 'k' AS product_id, '' AS seller_product_id, '1.5' AS timestamp FROM events",
)
def event_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw event payloads as one-item product lists."""
    renamed = F.replace(F.col("props"), F.lit('"k"'), F.lit('"id"'))
    body = F.concat(F.lit('{"data":['), renamed, F.lit("]}"))
    bodies = star.table(spark, sf, "events").select(body.alias("body"))
    return payloads.normalize_payload(bodies, "body", "list", F.lit("1.5"))


@check(
    "SRC-11 SCA-21",
    """SELECT p_size::VARCHAR AS category_id, p_type AS category_name, lower(p_brand) AS category_urlKey,
      '{"category_id": "' || p_size || '", "category_name": "' || p_type || '", "category_urlKey": "' || lower(p_brand)
        || '", "children": [{"category_id": "' || p_partkey || '", "category_name": "' || p_name
        || '", "category_urlKey": "leaf"}]}' AS record FROM part""",
)
def category_payloads(spark: SparkSession, sf: str) -> DataFrame:
    part = star.table(spark, sf, "part")
    child = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("leaf").alias("url_key"))
    link = F.concat(F.lit("https://shop.example.com/"), F.lower("p_brand"), F.lit("/c"), F.col("p_size"))
    rows = part.select(
        X.link_id(link).alias("parent_id"),
        F.col("p_type").alias("parent_name"),
        X.link_key(link).alias("parent_key"),
        F.to_json(F.struct(F.array(child).alias("data"))).alias("body"),
    )
    return payloads.category_pages(rows, "body", ("parent_id", "parent_name", "parent_key"))


# ---- scalar functions ----


@check(
    "SCA-1",
    "SELECT c_custkey, upper(trim('  ' || c_mktsegment || ' ')) AS up, lower(trim(c_name)) AS low FROM customer",
)
def trimmed_text(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))
    return star.table(spark, sf, "customer").select(
        "c_custkey", F.upper(F.trim(padded)).alias("up"), F.lower(F.trim("c_name")).alias("low")
    )


@check(
    "SCA-2 SCA-3 SCA-4 SCA-5",
    """SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS number,
      TRY_CAST(p_type AS BIGINT) AS no_number, coalesce(TRY_CAST(p_type AS BIGINT), -1)::BIGINT AS defaulted,
      TRY_CAST(p_type AS BIGINT) IS NULL AS missing, NULL::DATE AS nothing FROM part""",
)
def safe_casts(spark: SparkSession, sf: str) -> DataFrame:
    text = X.to_type(F.col("p_type"), "bigint")
    return star.table(spark, sf, "part").select(
        "p_partkey",
        X.to_type(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), "bigint").alias("number"),
        text.alias("no_number"),
        X.or_default(text, -1, "bigint").alias("defaulted"),
        text.isNull().alias("missing"),
        X.typed_lit(None, "date").alias("nothing"),
    )


@check(
    "SCA-6 SCA-7",
    """SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-08-03') AS days,
      CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2001-08-03') <= 7 THEN '7-DAY'
        WHEN date_diff('day', o_orderdate::DATE, DATE '2001-08-03') <= 14 THEN '14-DAY'
        WHEN date_diff('day', o_orderdate::DATE, DATE '2001-08-03') <= 21 THEN '21-DAY'
        WHEN date_diff('day', o_orderdate::DATE, DATE '2001-08-03') <= 30 THEN '30-DAY' ELSE '60-DAY' END AS period
    FROM orders""",
)
def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    days = X.days_between(F.lit("2001-08-03").cast("date"), F.col("o_orderdate").cast("date"))
    return star.table(spark, sf, "orders").select(
        "o_orderkey", days.alias("days"), X.period_label(days).alias("period")
    )


@check(
    "SCA-8",
    """SELECT DISTINCT o_orderdate::DATE AS date, day(o_orderdate) AS day, month(o_orderdate) AS month,
      year(o_orderdate) AS year, (month(o_orderdate) - 1) // 3 + 1 AS quarter FROM orders""",
)
def calendar_parts(spark: SparkSession, sf: str) -> DataFrame:
    return star.table(spark, sf, "orders").select(*X.date_parts(F.col("o_orderdate").cast("date"))).distinct()


@check(
    "SCA-9",
    """SELECT o_orderkey, period, (o_orderdate - to_days(split_part(period, '-', 1)::INT))::DATE AS from_date
    FROM orders, (VALUES ('7-DAY'), ('30-DAY'), ('60-DAY')) p(period)""",
)
def period_starts(spark: SparkSession, sf: str) -> DataFrame:
    periods = F.explode(F.array(*[F.lit(p) for p in ("7-DAY", "30-DAY", "60-DAY")])).alias("period")
    rows = star.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), periods)
    return rows.select("o_orderkey", "period", X.period_start(F.col("d"), F.col("period")).alias("from_date"))


@check(
    "SCA-10",
    "SELECT conv_id, turn, trim(unnest(string_split(text, ','))) AS item FROM conversations WHERE text <> ''",
)
def csv_items(spark: SparkSession, sf: str) -> DataFrame:
    turns = star.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.explode(X.csv_items(F.col("text"))).alias("item"))


@check("SCA-11", "SELECT doc_id, lower(text) LIKE '%ing t%' AS has FROM documents")
def text_contains(spark: SparkSession, sf: str) -> DataFrame:
    return star.table(spark, sf, "documents").select("doc_id", X.contains_ci(F.col("text"), F.lit("ING t")).alias("has"))


@check("SCA-12", over_star("SELECT product_id, product_code FROM dim_product"))
def product_codes_from_urls(spark: SparkSession, sf: str) -> DataFrame:
    return star.stored(spark, sf, "dim_product").select(
        "product_id", X.product_id_from_url(F.col("product_url")).alias("product_code")
    )


@check(
    "SCA-13",
    "SELECT l_orderkey, l_linenumber, (l_quantity * 1000000)::DECIMAL(15,2) AS price FROM lineitem",
)
def price_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("₫"), F.col("l_quantity").cast("int"), F.lit(".000.000"))
    return star.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", X.money(X.clean_price(text, "₫.")).alias("price")
    )


@check(
    "SCA-14",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN NULL ELSE (l_quantity / 100)::DECIMAL(5,2) END AS rate
    FROM lineitem""",
)
def discount_texts(spark: SparkSession, sf: str) -> DataFrame:
    percent = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("% Off"))
    text = F.when(F.col("l_quantity") > 45, "").otherwise(percent)
    return star.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.discount_rate(text).alias("rate"))


@check(
    "SCA-15",
    f"""SELECT l_orderkey, l_linenumber, ({SOLD_SQL})::BIGINT AS sold
    FROM (SELECT *, l_quantity::BIGINT AS units FROM lineitem)""",
)
def sold_texts(spark: SparkSession, sf: str) -> DataFrame:
    units = F.col("l_quantity").cast("bigint")
    return star.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", X.sold_count(sold_text(units)).alias("sold")
    )


@check(
    "SCA-16",
    "SELECT c_custkey, 'đà nẵng ' || c_custkey AS place FROM customer",
)
def place_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("| TP.ĐÀ NẴNG - "), F.col("c_custkey"), F.lit(" "))
    return star.table(spark, sf, "customer").select("c_custkey", F.lower(X.clean_location(text)).alias("place"))


@check(
    "SCA-17",
    "SELECT p_partkey, string_split(p_name, ' ')[2] AS second, string_split(p_name, ' ')[9] AS ninth FROM part",
)
def array_items(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    return star.table(spark, sf, "part").select(
        "p_partkey", X.item_at(words, 2).alias("second"), X.item_at(words, 9).alias("ninth")
    )


@check(
    "SCA-18 SCA-20",
    """SELECT p_partkey, (p_size * p_retailprice::DECIMAL(15,2))::DECIMAL(38,2) AS amount,
      trunc(p_size * p_retailprice::DECIMAL(15,2))::BIGINT AS whole FROM part""",
)
def exact_amounts(spark: SparkSession, sf: str) -> DataFrame:
    value = X.amount(F.col("p_size"), F.col("p_retailprice").cast("decimal(15,2)"))
    return star.table(spark, sf, "part").select("p_partkey", value.alias("amount"), X.to_long(value).alias("whole"))


@check(
    "SCA-19",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity * 12
      WHEN l_linenumber = 2 THEN 0 ELSE 1000 + (l_quantity - 10) * 12 END::DECIMAL(38,2) AS amount FROM lineitem""",
)
def carried_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Line 1 has no earlier snapshot, line 2 no new units."""
    line = F.col("l_linenumber")
    units = F.when(line == 2, F.lit(0)).otherwise(F.col("l_quantity").cast("bigint"))
    value = (units * 12).cast("decimal(38,2)")
    carried = X.adjusted_amount(units, value, F.lit(10), F.lit("1000.00").cast("decimal(38,2)"), line != 1)
    return star.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", carried.alias("amount"))


@check(
    "SCA-21",
    """SELECT page_id, lower(trim(string_split(url, '/')[-1])) AS tail, string_split(url, '.')[-1] AS id FROM pages""",
)
def url_tails(spark: SparkSession, sf: str) -> DataFrame:
    return star.table(spark, sf, "pages").select(
        "page_id", X.url_tail(F.col("url")).alias("tail"), X.id_tail(F.col("url")).alias("id")
    )


@check("SCA-22", over_star("SELECT sale_id, format('{:,}', (units_sold * 1234567)::BIGINT) AS shown FROM fact_sales"))
def grouped_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return star.stored(spark, sf, "fact_sales").select("sale_id", X.grouped(F.col("units_sold") * 1234567).alias("shown"))


@check(
    "SCA-23",
    "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
)
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return star.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@check(
    "UDF-1",
    f"""SELECT l_orderkey, l_linenumber, ({SOLD_SQL})::BIGINT AS sold, (units / 100)::DECIMAL(5,2) AS rate,
      'Hà Nội ' || l_returnflag AS place, l_partkey::VARCHAR AS product_id,
      CASE WHEN units < 8 THEN '7-DAY' WHEN units < 15 THEN '14-DAY' WHEN units < 22 THEN '21-DAY'
        WHEN units < 31 THEN '30-DAY' ELSE '60-DAY' END AS period
    FROM (SELECT *, l_quantity::BIGINT AS units FROM lineitem)""",
)
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    X.register_functions(spark)
    units = F.col("l_quantity").cast("bigint")
    texts = star.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        sold_text(units).alias("sold_text"),
        F.concat(F.lit("\t"), units.cast("string"), F.lit("\u00a0% Off")).alias("rate_text"),
        F.concat(F.lit("|TP.\u00a0Hà Nội - "), "l_returnflag", F.lit("\u2003")).alias("place_text"),
        F.concat_ws(".", F.lit("https://shop.example.com/a-i"), "l_suppkey", F.concat("l_partkey", F.lit("?sp=1"))).alias("url"),
        units.cast("int").alias("days"),
    )
    view = table_source.as_view(texts, "texts")
    return spark.sql(
        f"""SELECT l_orderkey, l_linenumber, sold_count(sold_text) AS sold, discount_rate(rate_text) AS rate,
          clean_location(place_text) AS place, product_id_from_url(url) AS product_id, period_label(days) AS period
        FROM {view}"""
    )
