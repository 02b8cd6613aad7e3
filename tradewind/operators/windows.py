"""Latest-row choices per key.

`row_number = 1` and `rank = 1` let Spark keep only the leading rows of a key before the shuffle, so a
key with very many rows sends one row (or its ties) per input task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.calendar import period_rank
from tradewind.operators.skew import join_large


def first_per_key(df: DataFrame, key: list[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given total order."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, key: list[str], order: str = "date_id", tie: str = "sale_id") -> DataFrame:
    """Latest row per key."""
    return first_per_key(df, key, [F.col(order).desc(), F.col(tie).desc()])


def latest_rows(df: DataFrame, key: list[str], order: str = "date_id") -> DataFrame:
    """Every row whose order value is the highest of its key, ties included."""
    window = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.rank().over(window)).where("_rank = 1").drop("_rank")


def max_per_key(df: DataFrame, col: str, key: list[str], name: str | None = None) -> DataFrame:
    return df.groupBy(*key).agg(F.max(col).alias(name or f"max_{col}"))


def with_partition_max(df: DataFrame, col: str, key: list[str], name: str | None = None) -> DataFrame:
    """Every row with the maximum of its key; the maximum is aggregated first, then joined."""
    return join_large(df, max_per_key(df, col, key, name), key, "inner")


def rank_snapshots(df: DataFrame, key: list[str], order: str = "date_id", tie: str = "sale_id") -> DataFrame:
    """Number the snapshots of a key, newest first; keys are never null in the facts.

    Rows are counted per key and date first. The running sum of the counts gives each date its start,
    and the numbering itself runs inside one key and date, so no task holds all rows of a key. The numbered rows
    lie by key and date already; the starts are brought to them without another shuffle of the rows.
    """
    counts = df.groupBy(*key, order).agg(F.count(F.lit(1)).alias("_rows"))
    newer = Window.partitionBy(*key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, order, F.coalesce(F.sum("_rows").over(newer), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key, order).orderBy(F.col(tie).desc())
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    joined = join_large(numbered, starts, [*key, order], "inner", unique=True)
    return joined.select(*df.columns, (F.col("_start") + F.col("_rn")).alias("rn"))


def longest_period(df: DataFrame, key: list[str]) -> DataFrame:
    """The row with the longest report period per key; the lowest snapshot wins a tie."""
    return first_per_key(df, key, [period_rank(F.col("report_period")).desc(), F.col("snapshot_id").asc()])


def latest_version(dim: DataFrame, key: list[str]) -> DataFrame:
    """Latest product version per key by effective date, the newest id first on a tie."""
    return first_per_key(dim, key, [F.col("effective_date").desc(), F.col("product_id").desc()])
