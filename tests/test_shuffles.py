"""Shuffles of the test warehouse and of ranked snapshots: how many, and how wide."""

from __future__ import annotations

import pytest

from checks import star
from tests.conftest import rows
from tests.test_plans import plan
from tradewind.operators import joins, skew, windows
from tradewind.sources import storage


@pytest.fixture
def large(monkeypatch):
    """Every right side counts as too large for a broadcast."""
    monkeypatch.setattr(skew, "fits_broadcast", lambda *_: False)


@pytest.fixture
def line_items(spark, tmp_path):
    items = [(1, 7, "2001-08-01", 3.0), (1, 7, "2001-10-20", 4.0), (2, 7, "2001-10-05", 5.0), (None, 7, "2001-08-01", 6.0)]
    schema = "l_partkey bigint, l_suppkey bigint, l_shipdate string, l_quantity double"
    spark.createDataFrame(items, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_pairs_are_shuffled_as_line_items(spark, line_items):
    df = star.pairs(spark, line_items)
    text = plan(df)
    assert text.count("Exchange") == 1 and text.index("partial_sum") < text.index("Exchange")
    found = rows(df, "p_partkey", "sold", "u1", "u3", "u5", "u6")
    assert found == [(1, 7, 3, 3, 7, 7), (2, 5, None, 5, 5, 5), (None, 6, 6, 6, 6, 6)]


def test_pairs_are_counted_once_beside_large_parts(spark, line_items, large):
    df = star.described_pairs(spark, line_items)
    assert plan(df).count("partial_max") == plan(star.pairs(spark, line_items)).count("partial_max")
    assert rows(df, "p_partkey", "p_name", "sold") == [(1, "a", 7), (2, "b", 5)]


def test_ranked_snapshots_are_not_shuffled_again_for_their_starts(spark, large):
    data = [("a", 1, 10), ("a", 2, 11), ("a", 2, 12), ("b", 1, 13), ("b", 3, 14)]
    df = windows.rank_snapshots(spark.createDataFrame(data, "k string, date_id int, sale_id int"), ["k"])
    assert "approx_top_k" not in plan(df) and "_salt" not in plan(df)
    assert rows(df, "sale_id", "rn") == [(10, 3), (11, 2), (12, 1), (13, 2), (14, 1)]


def test_pairs_of_many_line_items_keep_their_tasks(spark, line_items, monkeypatch):
    """Adaptive execution would join the tasks by the bytes of the items, and their counters would then spill."""
    assert "REPARTITION_BY_COL" in plan(star.pairs(spark, line_items))
    monkeypatch.setattr(skew, "estimated_bytes", lambda _: 20 * skew.SPREAD_BYTES + 1)
    df = star.pairs(spark, line_items)
    assert "REPARTITION_BY_NUM" in plan(df) and ", 21)" in plan(df)
    assert rows(df, "p_partkey", "sold") == [(1, 7), (2, 5), (None, 6)]
    monkeypatch.setattr(skew, "estimated_bytes", lambda _: 5 * skew.SPREAD_BYTES)
    assert ", 8)" in plan(star.pairs(spark, line_items))
    monkeypatch.setattr(skew, "estimated_bytes", lambda _: None)
    assert "REPARTITION_BY_NUM" in plan(star.pairs(spark, line_items))


def test_older_snapshots_meet_their_latest_in_one_shuffle(spark, monkeypatch):
    """Key 0 is hot, keys may be null or NaN, and latest rows may hold nulls."""
    hot = [(0.0, i % 40, 100 + i, i) for i in range(400)]
    cold = [(float(k), d, 1000 + 10 * k + d, None if d == 2 else k) for k in range(1, 200) for d in (1, 2)]
    odd = [(None, 1, 5000, 1), (None, 2, 5001, 2), (float("nan"), 1, 5002, 1), (float("nan"), 2, 5003, 2), (500.0, 1, 5004, 1)]
    df = spark.createDataFrame([*hot, *cold, *odd], "k double, date_id int, sale_id int, units int").repartition(5)
    expected = rows(joins.against_latest(df, ["k"]))
    for module in (joins, skew):
        monkeypatch.setattr(module, "fits_broadcast", lambda *_: False, raising=False)
    found = joins.against_latest(df, ["k"])
    assert "SortMergeJoin" not in plan(found)
    assert found.columns == ["k", "date_id", "sale_id", "units", "latest_date_id", "latest_sale_id", "latest_units"]
    assert [str(r) for r in rows(found)] == [str(r) for r in expected] and len(expected) == 399 + 199 + 1
    assert found.where("sale_id = 5002 AND latest_sale_id = 5003").count() == 1
    assert found.where("k = 0 AND latest_sale_id = 499 AND latest_date_id = 39").count() == 399


def test_sales_alone_are_written_without_the_pairs(spark, sf):
    apart = f"{sf}/."
    alone = star.stored(spark, apart, "fact_sales", alone=True)
    assert rows(alone) == rows(star.stored(spark, sf, "fact_sales"))
    root = star._roots[spark.sparkContext.applicationId, apart]
    assert storage.names(spark, root) == ["fact_sales"]
