"""Dimension images of a batch: read in one pass, from records that are made once."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from checks import landing as fixture
from tests.conftest import rows
from tradewind.operators.cleaning import flat_listing, unnest
from tradewind.plans.dimensions import dimension_images, load_dims, member_images
from tradewind.plans.warehouse import Warehouse, staging
from tradewind.schemas import LANDING
from tradewind.session import scratch_path


def batch(spark, platform_id):
    if platform_id == 10:
        places = ["|hà nội", "TP. hồ chí minh", "|hà nội", "", None]
        return spark.createDataFrame([Row(location=p) for p in places], "location string")
    if platform_id == 11:
        names = ["brandId", "brandName", "sellerId", "sellerName", "location"]
        items = [(" 1 ", "b", "7", "s", " x"), ("1", "a", "7", None, "x"), ("", "none", "x", "none", None), ("2", None, "8", "t ", "X "), None]
        items += [(None, None, None, None, None)]
        products = [[None if i is None else dict(zip(names, i, strict=True)) for i in items], [], None]
        return flat_listing(_pages(spark, products), 11)
    data = [
        {"brand": {"id": 3, "name": " b"}, "current_seller": {"id": 7, "name": "s", "link": "u"}},
        {"brand": {"id": 3, "name": "a"}, "current_seller": {"id": 7, "name": "s", "link": None}},
        {"brand": {"id": 4, "name": None}, "current_seller": {"id": None, "name": "r", "link": "v"}},
        {"brand": None, "current_seller": None},
        None,
    ]
    return spark.createDataFrame([("p", d) for d in data * 2], "product_id string, data " + _field(spark, 12, "data"))


def _field(spark, platform_id, name):
    return spark.createDataFrame([], LANDING[platform_id]).schema[name].dataType.simpleString()


def _pages(spark, products):
    kind = f"products {_field(spark, 11, 'products')}, main_info {_field(spark, 11, 'main_info')}"
    return spark.createDataFrame([(p, None) for p in products], kind)


@pytest.mark.parametrize("platform_id", [10, 11, 12])
def test_one_pass_gives_the_images_of_each_dimension(spark, platform_id):
    df = batch(spark, platform_id)
    wanted = dimension_images(df, platform_id)
    with staging(spark) as stage:
        found = member_images(df, platform_id, stage)
        assert list(found) == list(wanted)
        for name, image in wanted.items():
            assert found[name].dtypes == image.dtypes and rows(found[name]) == rows(image) != []


def test_a_batch_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    df = batch(spark, 12)

    def counted(batches):
        for part in batches:
            read.add(part.num_rows)
            yield part

    warehouse = Warehouse(spark, scratch_path(spark, "once")).create()
    with staging(spark) as stage:
        load_dims(warehouse, df.mapInArrow(counted, df.schema), 12, stage)
    assert (warehouse.read("dim_brand").count(), warehouse.read("dim_seller").count()) == (2, 1)
    assert read.value == df.count()


def test_records_are_made_once_and_without_casts(spark, sf):
    def plan(platform_id):
        df = flat_listing(fixture.landing(spark, sf, platform_id, 1), platform_id)
        return dimension_images(df, platform_id)["dim_brand"]._jdf.queryExecution().optimizedPlan().toString()

    assert plan(12).count("https://img") == 1 and "cast(struct" not in plan(12)
    assert plan(11).count("https://img") == 2  # one per item of the page


def test_unnesting_passes_over_empty_and_missing_arrays(spark):
    df = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "id int, items array<int>")
    assert rows(unnest(df, "items", {"id": F.col("id")}, "item").fillna(-1)) == [(-1, 1), (1, 1)]
