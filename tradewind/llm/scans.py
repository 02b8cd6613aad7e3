"""Numbers and running sums over a whole table in one order, computed in pieces that any task can redo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, bounded


def pieces(df: DataFrame, most_rows: int = 500_000) -> int:
    """Tasks for a table: those of a shuffle, or more if a piece would have too many rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // most_rows))


def numbered(df: DataFrame, order: list[Column], stage: Stage, name: str) -> DataFrame:
    """The rows with `_number`, from 0 in the given order, and `_piece`, the stretch of numbers a row lies in.

    The order should be total but for rows that are alike; rows that compare equal stay in one piece.
    """
    place = F.monotonically_increasing_id()
    parted = df.repartitionByRange(pieces(df), *order).sortWithinPartitions(*order)
    parted = stage.put(parted.select("*", F.spark_partition_id().alias("_piece"), place.alias("_place")), f"{name}-sorted")
    counts = parted.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage.put(counts.select("_piece", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), f"{name}-starts")
    joined = parted.join(bounded(starts, starts.count(), 16), "_piece")
    return stage.put(joined.withColumn("_number", F.col("_place") + F.col("_shift")).drop("_place", "_shift"), name)


def running(df: DataFrame, group: str, sums: dict[str, Column], stage: Stage, name: str) -> DataFrame:
    """The rows with running sums, this row included, of each group of consecutive numbers.

    Sums run within a piece; a group that spans several pieces carries on what the earlier ones had.
    """
    values = df.select("*", *[value.alias(f"_value_{key}") for key, value in sums.items()])
    totals = values.groupBy("_piece", group).agg(*[F.sum(f"_value_{key}").alias(f"_all_{key}") for key in sums])
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_piece", group, *[F.sum(f"_all_{key}").over(before).alias(f"_from_{key}") for key in sums])
    carried = stage.put(carried.where(" AND ".join(f"_from_{key} IS NOT NULL" for key in sums)), f"{name}-carried")
    within = Window.partitionBy("_piece", group).orderBy("_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = values.select("*", *[F.sum(f"_value_{key}").over(within).alias(f"_in_{key}") for key in sums]).drop(*[f"_value_{key}" for key in sums])
    joined = local.join(bounded(carried, carried.count(), 64), ["_piece", group], "left")
    found = [(F.col(f"_in_{key}") + F.coalesce(f"_from_{key}", F.lit(0))).alias(key) for key in sums]
    return stage.put(joined.select(*df.columns, *found), name)
