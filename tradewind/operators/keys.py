"""Surrogate ids without a sequence and without a single-task numbering.

Rows are grouped by the leading hex digits of the md5 of their natural key. Only the row counts of
these groups (16^digits at most) are summed up in one place; the numbering itself runs inside each
group. The ids depend on the content alone, so a task that runs again gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def key_digest(keys: list[str]) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
    return F.md5(F.concat_ws("\u001f", *parts))


def group_offsets(counts: DataFrame, order: list[Column]) -> DataFrame:
    """Running start of each group; the input holds one row per group, a bounded number."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def assign_ids(
    df: DataFrame,
    id_col: str,
    keys: list[str],
    existing: DataFrame | None = None,
    digits: int = DIGITS,
    start: int = 0,
) -> DataFrame:
    """Add dense ids that follow `start`, or the highest id of the existing rows; keys must be unique."""
    tagged = df.withColumn("_digest", key_digest(keys)).withColumn("_group", F.substring("_digest", 1, digits))
    counts = tagged.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = group_offsets(counts, [F.col("_group")]).select("_group", "_offset")
    inside = Window.partitionBy("_group").orderBy("_digest", *keys)
    first = F.lit(start).cast("bigint")
    if existing is not None:
        first = F.coalesce(existing.agg(F.greatest(F.max(id_col), F.lit(0))).scalar(), F.lit(0)).cast("bigint")
    numbered = tagged.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), "_group").select(
        (first + F.col("_offset") + F.col("_rn")).cast("bigint").alias(id_col), *df.columns
    )
