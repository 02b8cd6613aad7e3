"""Joins of a large table that survive hot keys.

The right side is broadcast only when Spark's own size estimate of it is under a limit. Beyond
the limit both sides are shuffled, and keys that hold a large share of the left rows are spread
over as many tasks as their share calls for: their left rows get a salt computed from the row and
its input partition, and the matching right rows are copied once per salt. All shares add up to one
at most, so the copies of one right row set number no more than the tasks. Other keys are not copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import setting

BROADCAST_LIMIT = 32 * 1024 * 1024
HOT_SHARE = 0.0025
HOT_KEYS = 400
TRACKED_KEYS = 4096
MERGERS = 128
SPREAD_BYTES = 2 * 1024 * 1024
SMALL_TASKS = 4

_SUPPORTED = {"inner", "left", "left_semi", "left_anti"}


@contextmanager
def colocated(spark: SparkSession) -> Iterator[None]:
    """Joins planned within may use a layout by some of their keys, such as buckets, instead of a shuffle by all."""
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        yield


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's size estimate of a plan; None where the session does not expose it.

    Taken before optimisation, which is cheap and never below the estimate of the optimised plan.
    """
    try:
        return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    except AttributeError:
        return None


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= limit


def spread(df: DataFrame, keys: list[str], task_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Rows dealt out by key for a step that needs many times their bytes, such as an aggregation of narrow rows.

    Adaptive execution joins small partitions by their compressed bytes and cannot know what the step makes of them,
    so a large frame goes to a fixed number of tasks: the shuffle partitions, or one per `task_bytes` of Spark's
    size estimate if that is more. A frame of few such tasks is left to adaptive execution.
    """
    size, tasks = estimated_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size is None:
        return df.repartition(tasks, *keys)
    wanted = -(-size // task_bytes)
    return df.repartition(*keys) if wanted <= SMALL_TASKS else df.repartition(max(tasks, wanted), *keys)


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Digests of the keys that hold at least the given share of the rows.

    One pass over the key columns with a frequent-items sketch of fixed size. Sketches are merged in
    two steps, so that no task merges those of all input tasks. At most 1 / share keys can qualify,
    which bounds the result. A key reported by mistake only costs some copies, so approximate counts
    are enough.
    """
    digests = df.select(
        F.xxhash64(*keys).alias("_digest"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_merger")
    )
    sketches = digests.groupBy("_merger").agg(
        F.expr(f"approx_top_k_accumulate(_digest, {TRACKED_KEYS})").alias("_sketch"),
        F.count(F.lit(1)).alias("_rows"),
    )
    merged = sketches.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(_sketch, {TRACKED_KEYS})").alias("_sketch"), F.sum("_rows").alias("_rows")
    )
    return (
        merged.select(F.explode(F.expr(f"approx_top_k_estimate(_sketch, {HOT_KEYS})")).alias("_entry"), "_rows")
        .where(F.col("_entry.count") >= F.col("_rows") * F.lit(share))
        .select(F.col("_entry.item").alias("_digest"), (F.col("_entry.count") / F.col("_rows")).alias("_share"))
    )


def split_hot(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of the few hot ones; the second frame costs nothing where there are none."""
    hot = hot_keys(df, keys).select("_digest")
    tagged = df.withColumn("_digest", F.xxhash64(*keys))
    return (
        tagged.join(F.broadcast(hot), "_digest", "left_anti").drop("_digest"),
        tagged.join(F.broadcast(hot), "_digest", "left_semi").drop("_digest"),
    )


def _with_salts(df: DataFrame, hot: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Add `_salts`, the number of pieces of each row's key: 1 for ordinary keys."""
    pieces = F.greatest(F.lit(2), F.ceil(F.col("_share") * F.lit(2 * tasks)).cast("int"))
    return (
        df.withColumn("_digest", F.xxhash64(*keys))
        .join(F.broadcast(hot), "_digest", "left")
        .withColumn("_salts", F.when(F.col("_share").isNull(), 1).otherwise(pieces))
        .drop("_digest", "_share")
    )


def _row_digest(df: DataFrame) -> Column:
    """Differs between rows, and between copies of a row in different input partitions."""
    hashable = [name for name, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    return F.xxhash64(*hashable, F.spark_partition_id())


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    profile: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which hot keys of the left side are spread over several tasks."""
    if how not in _SUPPORTED:
        raise ValueError(f"{how} join is not supported, use one of {sorted(_SUPPORTED)}")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(profile if profile is not None else left, keys)
    spread = (
        _with_salts(left.withColumn("_row", _row_digest(left)), hot, keys, tasks)
        .withColumn("_salt", F.pmod(F.col("_row"), F.col("_salts")).cast("int"))
        .drop("_row", "_salts")
    )
    copies = (
        _with_salts(right, hot, keys, tasks)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .drop("_salts")
    )
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_large(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    profile: DataFrame | None = None,
    unique: bool = False,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Join a large left side: broadcast a right side of checked size, else a salted shuffle join.

    `profile` may name a cheaper frame with the same key distribution as the left side, for
    example the bare fact table under a chain of joins. With `unique` the caller knows that no key
    occurs twice on the left, so there is nothing to spread and no pass to look for it.
    """
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), keys, how)
    if unique:
        return left.join(right, keys, how)
    return salted_join(left, right, keys, how, profile)
