"""Seeds and insert-only dimensions."""

from __future__ import annotations

import datetime as dt
from contextlib import AbstractContextManager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import date_parts
from tradewind.operators.cleaning import (
    brand_columns,
    brand_rows,
    dedupe,
    drop_null_keys,
    location_columns,
    location_rows,
    seller_columns,
    seller_rows,
)
from tradewind.operators.joins import new_rows
from tradewind.operators.sets import union_all
from tradewind.operators.trees import resolve_parents
from tradewind.plans.warehouse import Stage, Warehouse, staging
from tradewind.schemas import (
    P10,
    P11,
    P12,
    PLATFORMS,
    UNKNOWN_BRAND_NAME,
    UNKNOWN_CATEGORY_NAME,
    UNKNOWN_CODE,
    UNKNOWN_LOCATION_ID,
    UNKNOWN_LOCATION_NAME,
    UNKNOWN_SELLER_NAME,
    UNKNOWN_URL,
)
from tradewind.sinks.ledger import insert_if_absent
from tradewind.sources.tables import rows_to_df

NATURAL_KEYS = {
    "dim_category": ("category_id", ["category_code", "platform_id"]),
    "dim_brand": ("brand_id", ["brand_code", "platform_id"]),
    "dim_seller": ("seller_id", ["seller_code", "platform_id"]),
    "dim_location": ("location_id", ["location_name"]),
    "dim_date": ("date_id", ["date"]),
}


def insert_new(warehouse: Warehouse, name: str, image: DataFrame, stage: Stage) -> None:
    """Append what the dimension lacks; the new rows are found once and then numbered."""
    id_col, keys = NATURAL_KEYS[name]
    warehouse.add(name, lambda table: stage(new_rows(image, table, keys, unique=True), name), id_col=id_col, keys=keys)


def days_of(spark: SparkSession, as_of: dt.date | str | DataFrame) -> DataFrame:
    """Distinct days as `date`: of a frame that has such a column, or the given one."""
    if isinstance(as_of, DataFrame):
        return as_of.where("date IS NOT NULL").select("date").distinct()
    return spark.range(1).select(F.lit(str(as_of)).cast("date").alias("date"))


def unknown_members(platforms: DataFrame) -> dict[str, DataFrame]:
    """The rows that stand for a missing member, one per platform."""
    code = F.lit(UNKNOWN_CODE).cast("bigint")
    return {
        "dim_category": platforms.select(
            code.alias("category_code"),
            "platform_id",
            F.lit(UNKNOWN_CATEGORY_NAME).alias("category_name"),
            F.lit(UNKNOWN_URL).alias("category_url"),
            F.lit(None).cast("bigint").alias("parent_id"),
            F.lit(0).alias("level"),
        ),
        "dim_brand": platforms.select(
            code.alias("brand_code"), F.lit(UNKNOWN_BRAND_NAME).alias("brand_name"), "platform_id"
        ),
        "dim_seller": platforms.select(
            code.alias("seller_code"),
            F.lit(UNKNOWN_SELLER_NAME).alias("seller_name"),
            F.lit(UNKNOWN_URL).alias("seller_url"),
            "platform_id",
        ),
    }


def _present_seeds(warehouse: Warehouse) -> set[tuple[str, int]]:
    """Which seed rows exist: at most one per table and platform, so the answer is a handful of rows."""
    code = F.lit(UNKNOWN_CODE)
    found = [
        warehouse.read(name).where(F.col(column) == code).select(F.lit(name).alias("name"), "platform_id")
        for name, column in (
            ("dim_category", "category_code"),
            ("dim_brand", "brand_code"),
            ("dim_seller", "seller_code"),
        )
    ]
    place = warehouse.read("dim_location").where(F.col("location_id") == UNKNOWN_LOCATION_ID)
    nowhere = F.lit(0).alias("platform_id")
    found += [
        warehouse.read("dim_platform").select(F.lit("dim_platform").alias("name"), "platform_id"),
        place.select(F.lit("dim_location").alias("name"), nowhere),
    ]
    return {(row["name"], row["platform_id"]) for row in union_all(*found).distinct().collect()}


def seed(warehouse: Warehouse, as_of: dt.date | str | DataFrame) -> None:
    """Platforms, the rows of one or many days and every unknown member, each only when absent."""
    spark = warehouse.spark
    present = _present_seeds(warehouse)

    def absent(name: str) -> list[int]:
        return [p for p in PLATFORMS if (name, p) not in present]

    def platforms(ids: list[int]) -> DataFrame:
        return rows_to_df(spark, [(p, PLATFORMS[p]) for p in ids], "platform_id int, platform_name string")

    def insert(name: str, rows: DataFrame) -> None:
        id_col, keys = NATURAL_KEYS[name]
        warehouse.add(name, lambda table: new_rows(rows, table, keys), id_col=id_col, keys=keys)

    if absent("dim_platform"):
        insert_if_absent(platforms(absent("dim_platform")), "dim_platform", warehouse.root, ["platform_id"])
    days = days_of(spark, as_of).select(*date_parts(F.col("date")))
    with staging(spark) as stage:
        insert_new(warehouse, "dim_date", days, stage)
    for name in ("dim_category", "dim_brand", "dim_seller"):
        if absent(name):
            insert(name, unknown_members(platforms(absent(name)).select("platform_id"))[name])
    if ("dim_location", 0) not in present:
        place = rows_to_df(
            spark, [(UNKNOWN_LOCATION_ID, UNKNOWN_LOCATION_NAME)], "location_id bigint, location_name string"
        )
        insert_if_absent(place, "dim_location", warehouse.root, ["location_id"])


def category_rows(tree: DataFrame) -> DataFrame:
    """Each category code counts once per platform, in its highest place."""
    return dedupe(tree, ["category_code", "platform_id"], ["level", "category_name", "category_url", "parent_code"])


def load_categories(warehouse: Warehouse, tree: DataFrame, stage: Stage) -> None:
    """New categories with ids and parent ids; parents may be new or known."""
    id_col, keys = NATURAL_KEYS["dim_category"]
    rows = category_rows(tree)
    warehouse.add(
        "dim_category",
        lambda table: stage(new_rows(rows, table, keys, unique=True), "dim_category"),
        id_col=id_col,
        keys=keys,
        finish=lambda fresh, table: resolve_parents(fresh, known=table),
    )


def dimension_images(rows: DataFrame, platform_id: int) -> dict[str, DataFrame]:
    """Brand, seller and location rows that a marketplace delivers."""
    images = {}
    if platform_id in (P11, P12):
        images["dim_brand"] = brand_rows(rows, platform_id)
        images["dim_seller"] = seller_rows(rows, platform_id)
    if platform_id in (P10, P11):
        images["dim_location"] = location_rows(rows, platform_id)
    return images


def load_places(
    warehouse: Warehouse, rows: DataFrame, platform_id: int, stage: Stage, turn: AbstractContextManager = nullcontext()
) -> None:
    """The places of a marketplace that names some; they are looked up and added within `turn`."""
    image = dimension_images(rows, platform_id).get("dim_location")
    with turn:
        if image is not None:
            insert_new(warehouse, "dim_location", image, stage)


def member_images(rows: DataFrame, platform_id: int, stage: Stage) -> dict[str, DataFrame]:
    """`dimension_images` from one pass over rows that are not staged themselves.

    Each row gives the members that it names. The distinct ones, which are few, are staged, and every image is cut from them.
    """
    columns = {}
    if platform_id in (P11, P12):
        columns["dim_brand"], columns["dim_seller"] = brand_columns(platform_id), seller_columns(platform_id)
    if platform_id in (P10, P11):
        columns["dim_location"] = location_columns(platform_id)
    names = list(dict.fromkeys(name for own in columns.values() for name in own))
    members = [
        F.struct(F.lit(what).alias("_what"), *[own.get(n, F.lit(None)).alias(n) for n in names])
        for what, own in columns.items()
    ]
    named = rows.select(F.explode(F.array(*members)).alias("_member")).select("_member.*")
    staged = stage(named.distinct(), "members")

    def image(what: str) -> DataFrame:
        key = NATURAL_KEYS[what][1][0]
        return dedupe(drop_null_keys(staged.where(F.col("_what") == what).select(*columns[what]), [key]), [key])

    return {what: image(what) for what in columns}


def load_dims(warehouse: Warehouse, rows: DataFrame, platform_id: int, stage: Stage) -> None:
    for name, image in member_images(rows, platform_id, stage).items():
        insert_new(warehouse, name, image, stage)
