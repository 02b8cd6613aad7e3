"""Warehouse tables, literal rows, views.

A table that was swapped as a whole lies in a version folder; the last numbered file below
`<root>/_versions/<name>` points to it. Other tables lie below their own name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tradewind.schemas import BUCKETED, PARTITIONS, TABLES
from tradewind.sources import storage


@dataclass(frozen=True)
class Pointer:
    """Where the current version of a table lies; `mark` is what its writer noted with it."""

    number: int
    path: str | None
    mark: int


def pointer(spark: SparkSession, name: str, root: str) -> Pointer:
    """The pointer of a table; number 0 and no path for one that was never swapped."""
    number, text = storage.last_numbered(spark, f"{root.rstrip('/')}/_versions/{name}")
    return Pointer(number, *json.loads(text)) if text else Pointer(number, None, 0)


def table_path(spark: SparkSession, name: str, root: str) -> str:
    """The folder that holds the rows of a warehouse table."""
    return pointer(spark, name, root).path or f"{root.rstrip('/')}/{name}"


_buckets: dict[str, int] = {}


def bucket_count(spark: SparkSession, root: str) -> int:
    """The number of buckets that a warehouse was created with; 0 where facts are not bucketed."""
    path = f"{root.rstrip('/')}/_buckets"
    if path not in _buckets:
        _buckets[path] = int(storage.read_text(spark, path)) if storage.exists(spark, path) else 0
    return _buckets[path]


def _bucketed(spark: SparkSession, name: str, path: str, count: int) -> DataFrame:
    """A bucketed folder as an external table of the session, whose scans need no shuffle for joins by the bucket's keys."""
    view = f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"
    spark.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")  # partitions are listed, not registered
    if not spark.catalog.tableExists(view):
        layout = f"PARTITIONED BY ({', '.join(PARTITIONS[name])}) CLUSTERED BY ({', '.join(BUCKETED[name])}) INTO {count} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {view} ({TABLES[name]}) USING parquet {layout} LOCATION '{path}'")
    spark.catalog.refreshTable(view)
    return spark.table(view)


def read_table(spark: SparkSession, name: str, root: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A catalog table, or a warehouse table below a root path; `schema` is for tables that are not declared."""
    if root is None:
        return spark.table(name)
    path = table_path(spark, name, root)
    count = bucket_count(spark, root) if name in BUCKETED else 0
    if count and storage.names(spark, path):
        return _bucketed(spark, name, path, count)
    declared = TABLES.get(name, schema)
    return (spark.read.schema(declared) if declared is not None else spark.read).parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric column."""
    return spark.read.jdbc(url, table, column, lower, upper, partitions, properties=options)


def rows_to_df(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows with declared types; no rows give an empty typed frame.

    They go through Arrow, which leaves a local relation of known size in the plan.
    """
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    arrow = to_arrow_schema(fields)
    arrays = [pa.array(list(values), type=kind) for values, kind in zip(columns, arrow.types, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), fields)


def as_view(df: DataFrame, name: str) -> str:
    """Register a frame for SQL under a name of its own, and return that name."""
    view = f"{name}_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(view)
    return view
