"""Lookups, change detection and the star join."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.filters import any_changed
from tradewind.operators.skew import fits_broadcast, join_large, split_hot
from tradewind.operators.windows import first_per_key, max_per_key
from tradewind.schemas import PRODUCT_KEY, UNKNOWN_CODE, UNKNOWN_LOCATION_ID, VERSIONED


def unknown_member(dim: DataFrame, platform_id: int, code: str, id_col: str) -> Column:
    """Id of the unknown member as a scalar subquery; null when it was not seeded."""
    members = dim.where((F.col(code) == UNKNOWN_CODE) & (F.col("platform_id") == platform_id))
    return members.agg(F.min(id_col)).scalar()


def lookup(
    df: DataFrame, dim: DataFrame, keys: list[str], id_col: str, default: Column, profile: DataFrame | None = None
) -> DataFrame:
    """Left lookup of a surrogate id; rows without a match get the default id."""
    ids = dim.select(*keys, F.col(id_col).alias("_found"))
    joined = join_large(df, ids, keys, "left", profile)
    return joined.withColumn(id_col, F.coalesce("_found", default)).drop("_found")


def lookup_location(df: DataFrame, dim: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Location by name alone."""
    return lookup(df, dim, ["location_name"], "location_id", F.lit(UNKNOWN_LOCATION_ID).cast("bigint"), profile)


def attach_product(fact: DataFrame, dim_product: DataFrame, unique: bool = False) -> DataFrame:
    """Facts with id and measures of the current product version; others drop out."""
    current = dim_product.where("flag").select(*PRODUCT_KEY, "product_id", "sold", "price")
    return join_large(fact, current, PRODUCT_KEY, "inner", unique=unique)


def new_rows(image: DataFrame, dim: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Rows of the image whose natural key is not in the table; a null key is always new.

    `unique` says that the image has one row per key, as after `dedupe`.
    """
    stored = dim.select(*keys).distinct()
    return join_large(image, stored, keys, "left_anti", unique=unique).select(*image.columns)


def new_products(image: DataFrame, dim: DataFrame) -> DataFrame:
    return new_rows(image, dim.where("flag"), PRODUCT_KEY)


def changed_products(
    image: DataFrame, dim: DataFrame, cols: list[str] | None = None, null_safe: bool = False
) -> DataFrame:
    """Rows of the image that differ from the current version of their key."""
    cols = cols or VERSIONED
    current = dim.where("flag").select(*PRODUCT_KEY, F.struct(*cols).alias("_old"))
    joined = join_large(image.withColumn("_new", F.struct(*cols)), current, PRODUCT_KEY, "inner")
    return joined.where(any_changed("_new", "_old", cols, null_safe)).select(*image.columns)


def new_facts(image: DataFrame, fact: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Fact rows whose key combination was never stored; a null in the key counts as new.

    A product id stands for one code and seller, so these join the key without a change of the result. Facts
    in buckets of both are then compared where they lie, and only the image is shuffled.
    """
    return new_rows(image, fact, [*keys, *(c for c in PRODUCT_KEY if c not in keys)], unique)


def new_periodic(growth: DataFrame, table: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Growth rows not stored yet; neither date nor period belongs to the key. Buckets serve as in `new_facts`."""
    return new_rows(growth, table, [*keys, *(c for c in PRODUCT_KEY if c not in keys)], unique)


def with_previous(image: DataFrame, latest: DataFrame, unique: bool = False) -> DataFrame:
    """Rows with the units and amount of the previous snapshot, null where there is none."""
    previous = latest.select(
        *PRODUCT_KEY,
        F.col("sale_id").alias("prev_sale_id"),
        F.col("units_sold").alias("prev_units_sold"),
        F.col("total_sales_amount").alias("prev_total_sales_amount"),
    )
    return join_large(image, previous, PRODUCT_KEY, "left", unique=unique)


def against_latest(snapshots: DataFrame, key: list[str], order: str = "date_id", tie: str = "sale_id") -> DataFrame:
    """Every older snapshot next to the latest of its key.

    Where the latest rows are too large for a broadcast, an ordinary key's snapshots meet in one task anyway, and the
    first of them is read there: one shuffle, no join. The latest rows of the few hot keys are reduced before their
    shuffle and brought to the snapshots, which stay where they are. Rows with a null key have no partner, as in a join.
    """
    others = [c for c in snapshots.columns if c not in key]
    newest = [F.col(order).desc(), F.col(tie).desc()]

    def joined(rows: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
        latest = first_per_key(rows, key, newest)
        return rows.join(side(latest.select(*key, *[F.col(c).alias(f"latest_{c}") for c in others])), key)

    if fits_broadcast(snapshots):
        pairs = joined(snapshots, F.broadcast)
    else:
        ordinary, hot = split_hot(snapshots.where(reduce(and_, [F.col(c).isNotNull() for c in key])), key)
        window = Window.partitionBy(*key).orderBy(*newest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        firsts = [F.first(c).over(window).alias(f"latest_{c}") for c in others]
        beside = ordinary.select(*key, *others, *firsts)
        pairs = beside.unionByName(joined(hot, F.broadcast))
    return pairs.where(F.col(tie) != F.col(f"latest_{tie}"))


def with_date(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    return join_large(fact, dim_date.select("date_id", "date"), ["date_id"], "inner")


def not_in(values: DataFrame, table: DataFrame, col: str) -> DataFrame:
    return new_rows(values, table, [col])


def at_global_max(df: DataFrame, col: str) -> DataFrame:
    """Rows that carry the highest value of the whole frame, by a scalar subquery."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def newest_snapshot_keys(facts: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose latest date is the latest date of all facts."""
    return at_global_max(max_per_key(facts, "date_id", key, "date_id"), "date_id")


def star(
    fact: DataFrame,
    dims: Mapping[str, DataFrame],
    profile: DataFrame | None = None,
    single: bool = False,
) -> DataFrame:
    """Facts with the attributes of seven dimensions; products only in their current version.

    Every dimension is cut to the joined columns first. Inner joins drop rows without a member.
    `single` says that the facts have one row per product, so the product join has no hot key.
    """
    sides = [
        ("dim_product", ["product_id"], [c for c in dims["dim_product"].columns if c.startswith("product_")]),
        ("dim_seller", ["seller_id"], ["seller_name"]),
        ("dim_category", ["category_id"], ["category_name"]),
        ("dim_brand", ["brand_id"], ["brand_name"]),
        ("dim_location", ["location_id"], ["location_name"]),
        ("dim_date", ["date_id"], ["date"]),
        ("dim_platform", ["platform_id"], ["platform_name"]),
    ]
    result = fact
    for name, keys, attributes in sides:
        dim = dims[name]
        if name == "dim_product":
            extra = [c for c in ("price", "review_count", "rating_score", "sold") if c in dim.columns]
            names = [c for c in attributes if c not in keys and c != "product_code"]
            dim = dim.where("flag").select(*keys, *names, *extra)
        else:
            dim = dim.select(*keys, *attributes)
        result = join_large(result, dim, keys, "inner", profile, unique=single and name == "dim_product")
    return result
