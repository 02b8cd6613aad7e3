"""The warehouse: a folder of parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators.sets import union_all
from tradewind.operators.windows import latest_rows
from tradewind.schemas import LATEST, PLATFORMS, PRODUCT_KEY, TABLES
from tradewind.session import freed_shuffles, scratch_path
from tradewind.sinks.ledger import Ledger
from tradewind.sinks.tables import append_table, replace_partitions, swap_table
from tradewind.sources import storage
from tradewind.sources.tables import pointer, read_table


Stage = Callable[..., DataFrame]


@contextmanager
def staging(spark: SparkSession) -> Iterator[Stage]:
    """Frames written once to the shared folder, because later steps read them several times.

    The block gets `stage(df, label, by=())`, which returns the written copy, laid out by the given
    columns. It also cuts the lineage: a lost executor costs a read, not the steps before. The copies
    go when the block ends, and the shuffle files of each job within it when the job ends.
    """
    paths: list[str] = []

    def stage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
        path = scratch_path(spark, label)
        paths.append(path)
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        with freed_shuffles(spark):
            yield stage
    finally:
        for path in paths:
            storage.remove(spark, path)


class Warehouse:
    """Named tables below one root folder that all executors can reach.

    With `buckets`, the facts are laid out in that many buckets of products and sellers, so that joins of a
    load with their history do not shuffle the history. The number is kept with the warehouse.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def create(self, buckets: int = 0) -> Warehouse:
        for name in TABLES:
            storage.make_dirs(self.spark, f"{self.root}/{name}")
        if buckets:
            storage.create_new(self.spark, f"{self.root}/_buckets", str(buckets))
        return self

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, name, self.root)

    def append(self, name: str, df: DataFrame) -> None:
        append_table(df, name, self.root)

    def add(self, name: str, find: Callable[[DataFrame], DataFrame], scope: object = None, **how: Any) -> int:
        """A committed append: see `Ledger.add`."""
        return Ledger(self.spark, self.root, name, scope).add(find, **how)

    def replace(self, name: str, df: DataFrame) -> None:
        replace_partitions(df, name, self.root)

    def tables(self) -> dict[str, DataFrame]:
        """All tables, and the latest facts where the loads have kept them."""
        return {name: self.read(name) for name in TABLES} | {
            name: rows for fact, (name, _) in LATEST.items() if (rows := latest_facts(self, fact)) is not None
        }


def latest_facts(warehouse: Warehouse, fact: str, platform_id: int | None = None) -> DataFrame | None:
    """The latest rows of every product as the last fold left them; None before the first fold."""
    spark, name = warehouse.spark, LATEST[fact][0]
    platforms = PLATFORMS if platform_id is None else [platform_id]
    paths = [pointer(spark, f"{name}-{p}", warehouse.root).path for p in platforms]
    found = [spark.read.schema(TABLES[fact]).parquet(path) for path in paths if path]
    return union_all(*found) if found else None


def fold_latest(warehouse: Warehouse, fact: str, platform_id: int) -> None:
    """Take the facts that came since the last fold into the latest rows of their products.

    Facts are told apart by id, so files of earlier appends are skipped by their statistics. The new version
    is swapped in whole; a load that broke off before the fold is made up for by the next.
    """
    name, id_col = LATEST[fact]
    last = Ledger(warehouse.spark, warehouse.root, fact, platform_id).settled()
    while True:
        at = pointer(warehouse.spark, f"{name}-{platform_id}", warehouse.root)
        if at.path and (last is None or at.mark >= last.high):
            return
        came = warehouse.read(fact).where((F.col("platform_id") == platform_id) & (F.col(id_col) > at.mark))
        known = latest_facts(warehouse, fact, platform_id)
        rows = latest_rows(came if known is None else union_all(known, came.select(*known.columns)), PRODUCT_KEY)
        mark = last.high if last else came.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
        if swap_table(rows.select(*[f.name for f in StructType.fromDDL(TABLES[fact])]), f"{name}-{platform_id}", warehouse.root, at, mark):
            return
