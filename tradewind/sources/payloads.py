"""Raw API payloads to landing records; missing keys take defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.schemas import DETAIL_P12, PRODUCT_P11

_LIST_BODY = "data array<struct<id: string, seller_product_id: string>>"
_LISTING_BODY = f"""mods struct<listItems: array<{PRODUCT_P11}>>,
    mainInfo struct<trackParams: struct<category: string>, totalResults: string, pageSize: string>,
    seoInfo string"""


def _now() -> Column:
    return F.unix_micros(F.current_timestamp()) / F.lit(1_000_000)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def product_details(df: DataFrame, body: str, timestamp: Column | None = None) -> DataFrame:
    """Product pages; a body without id gives no record, one without category an empty category."""
    stamp = (timestamp if timestamp is not None else _now()).cast("string")
    ids = F.from_json(body, "id string, categories struct<id: string>")
    rows = df.select(ids.alias("ids"), F.from_json(body, DETAIL_P12).alias("data"))
    return rows.where(F.col("ids.id").isNotNull()).select(
        F.col("ids.id").alias("product_id"),
        _text(F.col("ids.categories.id")).alias("category_id"),
        stamp.alias("timestamp"),
        "data",
    )


def product_lists(df: DataFrame, body: str, timestamp: Column | None = None) -> DataFrame:
    """Product list pages: one record per product, with empty text for missing ids."""
    stamp = (timestamp if timestamp is not None else _now()).cast("string")
    rows = df.select(F.explode(F.from_json(body, _LIST_BODY)["data"]).alias("p"))
    return rows.select(
        _text(F.col("p.id")).alias("product_id"),
        _text(F.col("p.seller_product_id")).alias("seller_product_id"),
        stamp.alias("timestamp"),
    )


def listings(df: DataFrame, body: str, timestamp: Column | None = None) -> DataFrame:
    """Listing pages; missing product items become an empty array."""
    stamp = (timestamp if timestamp is not None else _now()).cast("double")
    rows = df.select(F.from_json(body, _LISTING_BODY).alias("b"))
    items = F.col("b.mods.listItems")
    return rows.select(
        F.coalesce(items, F.array().cast(f"array<{PRODUCT_P11}>")).alias("products"),
        F.col("b.mainInfo").alias("main_info"),
        F.coalesce(F.col("b.seoInfo"), F.lit("{}")).alias("seo_info"),
        stamp.alias("timestamp"),
    )


def _pages_type(levels: int) -> str:
    below = f"array<struct<{_pages_type(levels - 1)}>>" if levels else "string"
    return f"id: string, name: string, url_key: string, children: {below}"


def _goes_deeper(nodes: Column, levels: int) -> Column:
    """Whether nodes so many levels down still have children that the type leaves as text."""
    if not levels:
        return F.exists(nodes, lambda n: n["children"].isNotNull() & (n["children"] != "[]"))
    return F.exists(nodes, lambda n: F.coalesce(_goes_deeper(n["children"], levels - 1), F.lit(False)))


def _quoted(text: Column) -> Column:
    """A text as JSON writes it; null as null."""
    pair = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(pair, F.lit(6), F.length(pair) - 6))


def _record(code: Column, name: Column, key: Column, children: Column | None, levels: int) -> Column:
    """The nested landing record of a category as JSON; a node without children has no such key."""
    parts = [F.lit('{"category_id": '), _quoted(code), F.lit(', "category_name": '), _quoted(name), F.lit(', "category_urlKey": '), _quoted(key)]
    if children is not None:
        texts = F.transform(children, lambda n: _record(n["id"], n["name"], n["url_key"], n["children"] if levels else None, levels - 1))
        some = F.concat(F.lit(', "children": ['), F.array_join(texts, ", "), F.lit("]"))
        parts.append(F.when(F.size(children) > 0, some).otherwise(F.lit("")))
    return F.concat(*parts, F.lit("}"))


def category_pages(df: DataFrame, body: str, parent: tuple[str, str, str], levels: int = 4) -> DataFrame:
    """Sub-category pages under their parent (id, name, key columns).

    `record` is the nested landing record as JSON. Pages are read with a type of some levels, and of twice as many
    while a page goes deeper. A body that is null or no readable page gives no record.
    """
    id_col, name_col, key_col = parent
    nodes = F.col("page.data")
    while True:
        typed = df.withColumn("page", F.from_json(body, f"data array<struct<{_pages_type(levels)}>>")).where(nodes.isNotNull())
        if typed.where(_goes_deeper(nodes, levels)).isEmpty():
            break
        levels *= 2
    code = F.col(id_col).cast("string")
    return typed.select(
        code.alias("category_id"),
        F.col(name_col).alias("category_name"),
        F.col(key_col).alias("category_urlKey"),
        _record(code, F.col(name_col), F.col(key_col), nodes, levels).alias("record"),
    )


NORMALIZERS = {"detail": product_details, "list": product_lists, "listing": listings}


def normalize_payload(
    df: DataFrame,
    body: str,
    kind: str,
    timestamp: Column | None = None,
    parent: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Landing records of one payload kind: detail, list, listing, or category below a parent's columns."""
    if kind == "category":
        if parent is None:
            raise ValueError("category pages need the id, name and key columns of their parent")
        return category_pages(df, body, parent)
    return NORMALIZERS[kind](df, body, timestamp)
