"""Staged tables, bounded joins and Arrow helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import scratch_path
from tradewind.sources import storage

#: A side is broadcast by hand only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 16 * 1024 * 1024


class Stage:
    """Parquet tables in the shared folder that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = scratch_path(spark, label)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame and read it back with its own schema, so that an empty one stays typed."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        storage.remove(self.spark, f"{self.root}/{name}")


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Jobs started within give their workers Arrow batches of about this many bytes, or one longer row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark a frame for broadcast if its counted rows are few enough; otherwise it is joined by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def filter_by_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str, rows: int, row_bytes: int = 80) -> DataFrame:
    """Semi or anti join of a wide frame with narrow, distinct keys, without sorting the wide side."""
    if rows * row_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(keys), on, how)
    return df.join(keys.hint("shuffle_hash"), on, how)


#: Rows of one key that a join deals to one task.
GROUP_ROWS = 100_000


def join_groups(df: DataFrame, groups: DataFrame, on: str, rows: str, stage: Stage, name: str, salt: Column | None = None, most: int | None = None) -> DataFrame:
    """Inner join with one row per key that counts the key's rows; keys of many rows are dealt to several tasks.

    The piece of a row follows from its values. If rows repeat, give a salt: row numbers of a staged table, for one.
    """
    most = GROUP_ROWS if most is None else most
    if (groups.agg(F.max(rows)).first()[0] or 0) <= most:
        return df.join(groups, on)
    hot = stage.put(groups.where(F.col(rows) > most).select(on, F.ceil(F.col(rows) / most).cast("int").alias("_hot_cuts")), name)
    hot, cuts = bounded(hot, hot.count(), 16), F.coalesce("_hot_cuts", F.lit(1))
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if salt is None else F.xxhash64(salt)
    dealt = df.withColumn("_own", salt).join(hot, on, "left")
    dealt = dealt.withColumn("_cut", F.pmod("_own", cuts).cast("int")).drop("_own", "_hot_cuts")
    copies = groups.join(hot, on, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("_hot_cuts")
    return dealt.join(copies, [on, "_cut"]).drop("_cut")


def whole_rows(df: DataFrame) -> Column:
    """All columns of a row in one, so that none can clash with columns that an operator adds."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("_doc")


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a text column in one buffer and its n + 1 offsets; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = memoryview(data)[offsets[0] : offsets[-1]] if data is not None and len(column) else memoryview(b"")
    return bytes(body), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
