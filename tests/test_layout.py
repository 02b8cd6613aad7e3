"""How landing files and tables are laid out: compressed chunks, names in one listing, partitioned writes."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tradewind.session import scratch_path, setting
from tradewind.sinks import files, tables
from tradewind.sources import landing, storage


def test_compressed_chunks_are_landing_files(spark):
    folder = scratch_path(spark, "chunks")
    df = spark.range(105).select(F.col("id").cast("string").alias("product_id"))
    plain = files.write_chunks(df, folder, "list", "2024-07-21", 50, tasks=1)
    small = files.write_chunks(df, folder, "list", "2024-07-21", 50, tasks=1, compressed=True)
    more = files.write_chunks(df, folder, "list", "2024-07-21", 200, tasks=1)
    names = [name.rpartition("/")[2] for name in [*plain, *small, *more]]
    ends = ["json"] * 3 + ["json.gz"] * 3 + ["json"]
    assert names == [f"list-2024-07-21-{i}.{end}" for i, end in enumerate(ends, 1)]
    rows = landing.with_file_date(landing.read_json(spark, folder, "product_id string"))
    assert rows.count() == 315 and rows.where("file_date = DATE '2024-07-21'").count() == 315
    sizes = landing.read_json(spark, folder, "product_id string").groupBy("_metadata.file_name").count()
    assert {r["file_name"]: r["count"] for r in sizes.collect()} == dict(zip(names, [50, 50, 5, 50, 50, 5, 105], strict=True))


def test_a_newest_batch_may_be_compressed(spark):
    folder = scratch_path(spark, "newest")
    df = spark.range(7).select(F.col("id").cast("string").alias("product_id"))
    files.write_chunks(df, folder, "list", "2024-07-22", 5, tasks=1, compressed=True)
    batch, day = landing.latest_batch(spark, folder, "list", "product_id string")
    assert (batch.count(), day) == (7, dt.date(2024, 7, 22))


def test_names_with_any_signs_are_listed_whole(spark):
    folder = scratch_path(spark, "odd, names")
    storage.make_dirs(spark, folder)
    odd = ["a, b-1.json", "a-2.json", "a-3.json.gz", "a-4.json.bak"]
    for name in odd:
        storage.create_new(spark, f"{folder}/{name}", "x")
    assert storage.names_like(spark, folder, f"a*.{landing.SUFFIXES}") == odd[:3]
    assert storage.names_like(spark, folder, "none*") == storage.names_like(spark, f"{folder}-absent", "*") == []
    storage.rename_all(spark, folder, folder, [(odd[0], "b"), (odd[1], "c")])
    assert storage.names(spark, folder) == ["a-3.json.gz", "a-4.json.bak", "b", "c"]


def test_partitioned_tables_are_compressed_and_leave_settings(spark):
    """One file per partition from one task; that the write has no sort shows only in the memory of its tasks."""
    root, seen = scratch_path(spark, "unsorted"), "spark.sql.maxConcurrentOutputFileWriters"
    rows = spark.range(0, 40, 1, 1).select(
        F.col("id").alias("sale_id"), (F.col("id") % 2 + 1).alias("date_id"), (F.col("id") % 3 + 10).cast("int").alias("platform_id")
    )
    before = spark.conf.get(seen, None)
    tables.append_table(rows, "fact_sales", root)
    assert spark.conf.get(seen, None) == before
    written = storage.files_below(spark, f"{root}/fact_sales")
    data = [name for name in written if name.endswith(".parquet")]
    assert len(data) == 6 and all(name.endswith("zstd.parquet") for name in data)
    assert spark.read.parquet(f"{root}/fact_sales").count() == 40


def test_settings_go_back_when_threads_overlap(spark):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    first, second = setting(spark, name, "3"), setting(spark, name, "3")
    with ThreadPoolExecutor(1) as pool:
        first.__enter__()
        pool.submit(second.__enter__).result()
        first.__exit__(None, None, None)
        assert spark.conf.get(name) == "3"
        pool.submit(second.__exit__, None, None, None).result()
    assert spark.conf.get(name, None) == before
