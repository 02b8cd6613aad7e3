"""Null order of pages, odd white space, empty keywords, landing numbers, and whole landing streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import landing as fixture
from checks.star import CUTOFFS
from tests.conftest import rows
from tradewind.functions import text
from tradewind.functions.registry import register_functions
from tradewind.operators import filters, ranking
from tradewind.plans import incremental
from tradewind.plans.warehouse import Warehouse
from tradewind.session import scratch_path
from tradewind.sinks import files
from tradewind.sources import storage
from tradewind.streaming.landing_stream import run_incremental_stream

DAYS = dict(CUTOFFS)


def test_both_page_paths_order_nulls_last(spark):
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("measure"))
    for page in (1, 11, 20, 30):
        early = ranking.page_rows(df, "measure", ["id"], page, shallow=10_000)
        deep = ranking.page_rows(df, "measure", ["id"], page, shallow=0)
        assert rows(early, "id", "measure") == rows(deep, "id", "measure")


def test_empty_keyword_text_matches_nothing(spark):
    df = spark.createDataFrame([("shirt",), ("",), (None,)], "name string")
    assert filters.keyword_match(df, "", ["name"]).count() == 0


def test_discount_forms_agree_on_odd_space(spark):
    register_functions(spark)
    df = spark.createDataFrame([("35 % Off",), ("  12% Off\t",), ("",), (None,), ("x% Off",)], "s string")
    both = df.select(text.discount_rate(F.col("s")).alias("a"), F.expr("discount_rate(s)").alias("b"))
    assert both.where("NOT a <=> b").isEmpty() and both.where("a IS NOT NULL").count() == 2


def test_numbers_go_on_after_an_archived_file(spark):
    folder = scratch_path(spark, "archived")
    df = spark.range(30).select(F.col("id").cast("string").alias("product_id"))
    names = files.write_chunks(df, folder, "list", "2024-07-21", 10, tasks=1)
    storage.remove(spark, names[0])
    more = files.write_chunks(df, folder, "list", "2024-07-21", 100, tasks=1)
    assert [name.rsplit("-", 1)[1] for name in more] == ["4.json"]


@pytest.mark.parametrize("platform_id", [10, 11])
def test_streams_load_what_batches_load(spark, sf, platform_id):
    folder = scratch_path(spark, "landing")
    loaded, streamed = (Warehouse(spark, scratch_path(spark, "warehouse")).create() for _ in range(2))
    for date_id in (5, 6):
        batch = fixture.landing(spark, sf, platform_id, date_id)
        write = files.write_arrays if platform_id == 10 else files.write_chunks
        write(batch, folder, "details", DAYS[date_id], 10_000)
        incremental.run_incremental(loaded, batch, platform_id, DAYS[date_id])
    run_incremental_stream(streamed, folder, scratch_path(spark, "checkpoint"), platform_id, "details").awaitTermination()
    for name in ("dim_product", "fact_sales"):
        assert streamed.read(name).count() == loaded.read(name).count() > 0


def test_a_file_without_a_date_stops_the_stream(spark, sf):
    folder = scratch_path(spark, "landing")
    names = files.write_chunks(fixture.landing(spark, sf, 12, 5), folder, "details", DAYS[5], 10_000)
    storage.rename(spark, names[0], f"{folder}/details-undated.json")
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse")).create()
    query = run_incremental_stream(warehouse, folder, scratch_path(spark, "checkpoint"), 12, "details")
    with pytest.raises(Exception, match="without a date token"):
        query.awaitTermination()
