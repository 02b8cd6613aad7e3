"""What the loads leave on disk: compressed landing files, shuffles removed with their job, no second copy of a batch."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from checks import load_queries
from checks import landing as fixture
from checks.star import CUTOFFS
from tests.conftest import rows
from tradewind.operators.cleaning import PRODUCT_ROWS, dedupe, flat_listing
from tradewind.operators.joins import lookup, unknown_member
from tradewind.operators.keys import assign_ids
from tradewind.plans import incremental, products
from tradewind.plans.dimensions import seed
from tradewind.plans.warehouse import Warehouse, staging
from tradewind.schemas import LANDING, PRODUCT_KEY
from tradewind.session import scratch_path
from tradewind.sinks import files
from tradewind.sources import landing

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.mark.parametrize("platform_id", [10, 11, 12])
def test_snapshots_land_compressed(spark, sf, platform_id):
    folder = scratch_path(spark, "snapshots")
    load_queries.land_snapshots(spark, sf, platform_id, folder, [6])
    names = [name for name in os.listdir(folder) if not name.startswith(".")]
    assert names and all(name.startswith("details-2001-10-31-") and name.endswith(".json.gz") for name in names)
    batch, day = landing.latest_batch(spark, folder, "details", LANDING[platform_id], platform_id == 10)
    wanted = fixture.landing(spark, sf, platform_id, 6)
    assert str(day) == "2001-10-31" and rows(batch.select(F.to_json(F.struct("*")))) == rows(wanted.select(F.to_json(F.struct("*")))) != []


@pytest.mark.parametrize("rows_per_file", [1, 7, 50, 1_000])
def test_arrays_hold_the_records_that_their_numbers_say(spark, rows_per_file):
    folder = scratch_path(spark, "arrays")
    df = spark.range(0, 200, 1, 3).select((F.col("id") % 150).cast("string").alias("code"), F.when(F.col("id") % 4 > 0, "ä\n").alias("text"))
    paths = files.write_arrays(df, folder, "list", "2024-07-21", rows_per_file)
    found = sorted(sorted(json.dumps(r, sort_keys=True) for r in json.load(open(path))) for path in paths)
    numbered = assign_ids(df.select(F.to_json(F.struct("*")).alias("record")), "number", ["record"])
    wanted: dict[int, list[str]] = {}
    for row in numbered.collect():
        wanted.setdefault((row["number"] - 1) // rows_per_file, []).append(json.dumps(json.loads(row["record"]), sort_keys=True))
    assert found == sorted(sorted(part) for part in wanted.values())
    small = files.write_arrays(df, folder, "list", "2024-07-21", rows_per_file, compressed=True)
    assert len(small) == len(paths) and all(path.endswith(".json.gz") for path in small)
    assert landing.read_json(spark, folder, "code string", multiline=True).count() == 400


def test_groups_within_one_file_are_not_numbered(spark):
    records = spark.range(0, 5_000, 1, 2).select(F.col("id").cast("string").alias("record"))
    placed = files._with_chunks(records, 2_500)
    assert rows(placed.groupBy("chunk").count()) == [(0, 2_500), (1, 2_500)]
    numbered, whole = (files._with_chunks(records, n)._jdf.queryExecution().optimizedPlan().toString().count("row_number()") for n in (2_500, 5_000))
    assert numbered == whole == 1  # one of the two branches numbers, that of groups which cross a border


def test_jobs_of_a_staged_block_remove_their_shuffles(spark):
    before = spark.conf.get(FREED, None)
    with staging(spark) as stage:
        assert spark.conf.get(FREED) == "true"
        copy = stage(spark.range(0, 1_000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
        assert rows(copy) == rows(copy) and copy.count() == 7
    assert spark.conf.get(FREED, None) == before


@pytest.mark.parametrize("platform_id", [10, 11, 12])
def test_a_staged_batch_is_not_copied_again(spark, sf, platform_id):
    warehouse = Warehouse(spark, scratch_path(spark, "copies")).create()
    batch = fixture.landing(spark, sf, platform_id, 6)
    labels = []

    def stage(df, label, by=()):
        labels.append(label)
        return df

    kept = incremental._staged_rows(warehouse, batch, platform_id, "2001-10-31", stage, staged=True)
    assert (kept is batch, labels) == ((False, ["landing-rows"]) if platform_id == 11 else (True, []))
    assert warehouse.read("dim_date").count() == 1
    incremental._staged_rows(warehouse, batch, platform_id, "2001-10-31", stage)
    assert labels[-1] == "landing-rows"


@pytest.mark.parametrize("platform_id", [10, 11, 12])
def test_one_choice_keeps_the_products_of_two(spark, sf, platform_id):
    """Copies of a product under one code, and under several codes that no seller has."""
    warehouse = Warehouse(spark, scratch_path(spark, "choice")).create()
    seed(warehouse, "2001-10-31")
    flat = flat_listing(fixture.landing(spark, sf, platform_id, 6), platform_id)
    wide = flat.unionByName(flat.limit(50))
    sellers = warehouse.read("dim_seller")
    twice = lookup(
        PRODUCT_ROWS[platform_id](wide, dict(CUTOFFS)[6]),
        sellers.where(F.col("platform_id") == platform_id),
        ["seller_code", "platform_id"],
        "seller_id",
        unknown_member(sellers, platform_id, "seller_code", "seller_id"),
    )
    wanted = dedupe(twice.drop("seller_code"), PRODUCT_KEY)
    image = products.product_image(wide, sellers, platform_id, dict(CUTOFFS)[6])
    assert image.columns == wanted.columns and rows(image.drop("expired_date")) == rows(wanted.drop("expired_date")) != []
    count = image._jdf.queryExecution().optimizedPlan().toString().count("row_number()")
    assert count < wanted._jdf.queryExecution().optimizedPlan().toString().count("row_number()")
