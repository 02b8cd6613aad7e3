"""Sorting, top-k and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.keys import group_offsets, key_digest

PAGE_SIZE = 10
SHALLOW_ROWS = 10_000
SLICES = 200
_HEX_DIGITS = 2


def order(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*cols)


def top_k(df: DataFrame, col: str, k: int, ties: Sequence[str] = ("name",)) -> DataFrame:
    """The k highest rows; ties in the order of the given columns."""
    return df.orderBy(F.col(col).desc(), *ties).limit(k)


def numbered(df: DataFrame, measure: str, key: list[str], slices: int | None = None) -> DataFrame:
    """Position of every row by measure, highest first and null last, without one task holding all rows.

    Approximate quantiles cut the measure into slices of similar size. A value that fills a slice
    of its own is split further by the digest of the key, which is also the tie order. Counts per
    slice give the start positions, and each slice is numbered on its own, so positions are exact.
    There are twice as many slices as shuffle partitions, and no fewer than SLICES.
    """
    if slices is None:
        slices = max(SLICES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [(i + 1) / slices for i in range(slices)]
    cuts = df.agg(F.percentile_approx(measure, shares, 10_000)).first()[0] or []
    points = sorted(set(cuts))
    bounds = F.array(*[F.lit(p) for p in points]) if points else F.array().cast("array<double>")
    above = F.size(F.filter(bounds, lambda p: p > F.col(measure)))
    is_null = F.col(measure).isNull()
    is_cut = F.coalesce(F.array_contains(bounds, F.col(measure)), F.lit(False)) if points else F.lit(False)
    tagged = (
        df.withColumn("_digest", key_digest(key))
        .withColumn("_slice", F.when(is_null, 2 * len(points) + 2).otherwise(above * 2 + F.when(is_cut, 1).otherwise(0)))
        .withColumn("_part", F.when(is_cut | is_null, F.substring("_digest", 1, _HEX_DIGITS)).otherwise(""))
    )
    counts = tagged.groupBy("_slice", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = group_offsets(counts, [F.col("_slice"), F.col("_part")]).select("_slice", "_part", "_offset")
    inside = Window.partitionBy("_slice", "_part").orderBy(F.col(measure).desc(), "_digest", *key)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["_slice", "_part"])
        .select(*df.columns, (F.col("_offset") + F.col("_rn")).cast("bigint").alias("position"))
    )


def page_info(rows: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One row: current page, page size, number of pages; all zero when there are no rows."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    pages = F.ceil(F.col("n") / F.lit(size)).cast("int")
    return n.select(
        F.when(F.col("n") == 0, 0).otherwise(F.least(F.lit(max(page, 1)), pages)).alias("current_page"),
        F.when(F.col("n") == 0, 0).otherwise(size).alias("page_size"),
        pages.alias("total_page"),
    )


def page_rows(
    df: DataFrame, measure: str, key: list[str], page: int, size: int = PAGE_SIZE, shallow: int = SHALLOW_ROWS
) -> DataFrame:
    """Rows of one page with its number, size and the page count; pages beyond the last clamp to it.

    Early pages come from a top-k over all partitions. Deep pages use exact positions instead, so
    that no task has to hold everything before the page.
    """
    info = page_info(df, page, size).first()
    current, total = info["current_page"], info["total_page"]
    start = max(current - 1, 0) * size
    if start + size <= shallow:
        ranked = df.withColumn("_tie", key_digest(key)).orderBy(F.col(measure).desc(), "_tie", *key)
        rows = ranked.limit(start + size).offset(start).drop("_tie")
    else:
        rows = numbered(df, measure, key).where(F.col("position").between(start + 1, start + size)).drop("position")
    return rows.select(
        "*",
        F.lit(current).alias("current_page"),
        F.lit(size).alias("page_size"),
        F.lit(total).alias("total_page"),
    )


def page_batch(batch: Column, per_batch: Column, total: Column) -> tuple[Column, Column]:
    """First and last page number of a batch of page links."""
    return (batch - 1) * per_batch + 1, F.least(batch * per_batch, total)
