"""Hot keys, ids and positions at odds with even spread."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tradewind.operators.joins import against_latest, new_rows
from tradewind.operators.keys import assign_ids
from tradewind.operators.ranking import numbered, page_rows
from tradewind.operators.skew import fits_broadcast, hot_keys, join_large, salted_join
from tradewind.operators.windows import latest_per_key, with_partition_max


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share key 7, a tenth have no key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 500)
    return spark.range(6000).select("id", key.cast("bigint").alias("k"))


@pytest.fixture(scope="module")
def members(spark):
    return spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


def test_hot_keys_are_found(spark, skewed):
    found = hot_keys(skewed, ["k"]).select("_digest")
    seven = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint")).alias("_digest"))
    nothing = spark.range(1).select(F.xxhash64(F.lit(None).cast("bigint")).alias("_digest"))
    assert seven.join(found, "_digest", "left_anti").count() == 0
    assert nothing.join(found, "_digest", "left_anti").count() == 0
    assert found.count() <= 400


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(skewed, members, how):
    expected = rows(skewed.join(members, "k", how), "id")
    assert rows(salted_join(skewed, members, ["k"], how), "id") == expected
    assert rows(join_large(skewed, members, ["k"], how, limit=0), "id") == expected


def test_salted_join_spreads_the_hot_key(spark, skewed, members):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(skewed, members, ["k"]).where("k = 7").withColumn("p", F.spark_partition_id())
        biggest = joined.groupBy("p").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert biggest < 2000 / 2


def test_copies_of_one_row_are_spread(spark, members):
    copies = spark.range(0, 4000, 1, 8).select(F.lit(7).cast("bigint").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(copies, members, ["k"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000
    assert len(sizes) >= 3


def test_other_join_kinds_are_refused(skewed, members):
    with pytest.raises(ValueError, match="right"):
        salted_join(skewed, members, ["k"], "right")


def test_broadcast_needs_a_known_size(spark, members):
    assert fits_broadcast(members)
    assert not fits_broadcast(members, limit=10)


def test_null_keys_count_as_new(skewed, members):
    fresh = new_rows(skewed, members, ["k"])
    assert fresh.where("k IS NULL").count() == skewed.where("k IS NULL").count()


def test_ids_are_dense_and_repeatable(spark):
    df = spark.range(5000).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    known = spark.createDataFrame([(41,), (-1,)], "nid bigint")
    first = assign_ids(df, "nid", ["name"], existing=known)
    again = assign_ids(df.repartition(13), "nid", ["name"], existing=known)
    assert [r[0] for r in rows(first.select(F.lpad("nid", 6, "0")))] == [f"{n:06d}" for n in range(42, 5042)]
    assert rows(first) == rows(again)


def test_ids_start_at_one(spark):
    empty = spark.createDataFrame([], "nid bigint")
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    assert rows(assign_ids(df, "nid", ["name"], existing=empty), "nid") == [(1,), (2,)]


def test_positions_are_exact_with_many_ties(spark):
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 97).cast("bigint").alias("m")
    )
    got = {r["id"]: r["position"] for r in numbered(df, "m", ["id"], slices=20).collect()}
    digest = F.md5(F.col("id").cast("string"))
    order = [r["id"] for r in df.orderBy(F.col("m").desc(), digest).collect()]
    assert [got[i] for i in order] == list(range(1, 4001))


def test_deep_page_equals_shallow_page(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("m"))
    shallow = rows(page_rows(df, "m", ["id"], 37), "id", "current_page", "total_page")
    deep = rows(page_rows(df, "m", ["id"], 37, shallow=0), "id", "current_page", "total_page")
    assert shallow == deep
    assert len(shallow) == 10


@pytest.mark.parametrize(("page", "current", "n"), [(2, 2, 10), (9, 3, 5), (0, 1, 10), (-4, 1, 10)])
def test_page_clamps(spark, page, current, n):
    df = spark.range(25).select("id", F.col("id").alias("m"))
    found = page_rows(df, "m", ["id"], page).collect()
    assert {(r["current_page"], r["total_page"], r["page_size"]) for r in found} == {(current, 3, 10)}
    assert len(found) == n


def test_page_of_nothing_is_empty(spark):
    df = spark.range(0).select("id", F.col("id").alias("m"))
    assert page_rows(df, "m", ["id"], 1).count() == 0


def test_latest_of_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("date_id"),
        F.col("id").alias("sale_id"),
    )
    assert rows(latest_per_key(df, ["k"]).where("k = 1"), "date_id") == [(2899,)]
    assert with_partition_max(df, "date_id", ["k"]).where("k = 1 AND max_date_id = 2899").count() == 2900
    assert against_latest(df, ["k"]).count() == 2899
