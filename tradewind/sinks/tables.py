"""Warehouse writes: append, partition replacement, whole-table swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.schemas import BUCKETED, PARTITIONS, TABLES
from tradewind.session import setting
from tradewind.sources import storage
from tradewind.sources.tables import Pointer, bucket_count, pointer, table_path

#: Partitions that a task writes side by side; only a task that meets more of them sorts its other rows.
OPEN_FILES = 32
#: Bytes that an open file keeps in memory.
ROW_GROUP = 8 << 20


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns and types of the declared table; columns that the frame lacks become null."""
    if name not in TABLES:
        return df
    fields = StructType.fromDDL(TABLES[name]).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def write_rows(df: DataFrame, name: str, path: str, root: str, mode: str = "errorifexists", **options: str) -> None:
    """Write rows of a table to a folder in the table's layout.

    Where the warehouse has buckets, rows of the facts go to one file per bucket and partition, in a new folder.
    """
    spark, layout = df.sparkSession, PARTITIONS.get(name, [])
    count = bucket_count(spark, root) if name in BUCKETED else 0
    if not count:
        writer = df.write.mode(mode).option("compression", "zstd").options(**options).partitionBy(*layout)
        if not layout:
            writer.parquet(path)
            return
        with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
            writer.option("parquet.block.size", ROW_GROUP).parquet(path)
        return
    if mode != "errorifexists":
        raise ValueError(f"{name} is bucketed: rows are added by the ledger, which writes them to a folder of their own")
    keys, view = BUCKETED[name], f"rows_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")
    try:
        writer = df.repartition(count, *keys).write.partitionBy(*layout).bucketBy(count, *keys).sortBy(*keys)
        writer.option("path", path).saveAsTable(view)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {view}")


def append_table(df: DataFrame, name: str, root: str | None = None) -> None:
    """Append to a catalog table, or to a warehouse table below a root path."""
    if root is None:
        df.write.mode("append").saveAsTable(name)
        return
    write_rows(conform(df, name), name, table_path(df.sparkSession, name, root), root, "append")


def append_jdbc(df: DataFrame, url: str, table: str, tasks: int, batch_rows: int = 10_000, **options: str) -> None:
    """Append to a database table with a bounded number of connections."""
    df.coalesce(tasks).write.mode("append").option("batchsize", batch_rows).jdbc(url, table, properties=options)


def replace_partitions(df: DataFrame, name: str, root: str) -> None:
    """Replace exactly the partitions that occur in the frame.

    Spark writes to a staging folder first and exchanges the partitions when the job commits, so the
    frame may come from the table itself.
    """
    path = table_path(df.sparkSession, name, root)
    write_rows(conform(df, name), name, path, root, "overwrite", partitionOverwriteMode="dynamic")


def swap_table(df: DataFrame, name: str, root: str, after: Pointer | None = None, mark: int = 0) -> bool:
    """Write a whole new version of a table, then point to it; False when another writer has swapped it meanwhile.

    Until the pointer is written, readers see the old version, and they never see a part of either. A write
    that fails or breaks off leaves the old version in place. `after` is the pointer that the rows were computed
    from. The version before stays for readers that still use it; older ones go.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    folder = f"{root}/_versions/{name}"
    after = pointer(spark, name, root) if after is None else after
    path = f"{root}/_versions/{name}-{after.number + 1:012d}-{uuid.uuid4().hex}"
    try:
        write_rows(conform(df, name), name, path, root)
    except Exception:
        storage.remove(spark, path)
        raise
    if not storage.create_numbered(spark, folder, after.number + 1, json.dumps([path, mark])):
        storage.remove(spark, path)
        return False
    if after.number:
        storage.remove(spark, f"{root}/{name}")
    for version in storage.glob(spark, f"{root}/_versions/{name}-*"):
        if int(version.rpartition(f"/{name}-")[2][:12]) < after.number:
            storage.remove(spark, version)
    return True
