"""Committed appends, ids, version pointers, latest rows and buckets: repeated, broken and concurrent writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import landing as fixture
from checks import star
from tests.conftest import rows
from tradewind.operators.joins import new_facts
from tradewind.operators.skew import colocated
from tradewind.operators.windows import latest_rows
from tradewind.plans import incremental, reports
from tradewind.plans.warehouse import Warehouse, fold_latest, latest_facts
from tradewind.schemas import FACT_KEYS, LATEST, PRODUCT_KEY
from tradewind.session import scratch_path
from tradewind.sinks import files, tables
from tradewind.sinks.ledger import Ledger, insert_if_absent, take_ids
from tradewind.sources import storage
from tradewind.sources.tables import read_table, rows_to_df

DAYS = dict(star.CUTOFFS)
SELLER = "seller_code bigint, seller_name string, platform_id int"


def sellers(spark, *codes):
    return rows_to_df(spark, [(c, f"s{c}", 12) for c in codes], SELLER)


@pytest.fixture
def warehouse(spark):
    return Warehouse(spark, scratch_path(spark, "ledger")).create()


def add_sellers(warehouse, frame, **how):
    from tradewind.operators.joins import new_rows

    keys = ["seller_code", "platform_id"]
    return warehouse.add("dim_seller", lambda table: new_rows(frame, table, keys), id_col="seller_id", keys=keys, **how)


def test_ids_go_on_without_a_look_at_the_table(spark, warehouse):
    assert add_sellers(warehouse, sellers(spark, 5, 6)) == 2
    assert add_sellers(warehouse, sellers(spark, 6, 7)) == 1
    assert rows(warehouse.read("dim_seller"), "seller_code") == [(5,), (6,), (7,)]
    assert rows(warehouse.read("dim_seller"), "seller_id") == [(1,), (2,), (3,)]
    spark.sparkContext.setJobGroup("ids", "ids")
    try:
        assert take_ids(spark, warehouse.root, "dim_seller", "seller_id", 10) == 3
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("ids")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ids_follow_a_table_that_was_there_before(spark, warehouse):
    warehouse.append("dim_seller", sellers(spark, 1).withColumn("seller_id", F.lit(41).cast("bigint")))
    add_sellers(warehouse, sellers(spark, 2))
    assert rows(warehouse.read("dim_seller"), "seller_id") == [(41,), (42,)]


def test_a_load_that_breaks_off_before_its_commit_adds_nothing(spark, warehouse, monkeypatch):
    add_sellers(warehouse, sellers(spark, 1))
    with monkeypatch.context() as broken:
        broken.setattr(Ledger, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            add_sellers(warehouse, sellers(spark, 1, 2, 3))
    assert warehouse.read("dim_seller").count() == 1
    assert add_sellers(warehouse, sellers(spark, 2, 3)) == 2
    found = rows(warehouse.read("dim_seller"), "seller_id", "seller_code")
    assert len({i for i, _ in found}) == 3 and sorted(c for _, c in found) == [1, 2, 3]


def test_a_load_that_breaks_off_after_its_commit_is_completed(spark, warehouse, monkeypatch):
    with monkeypatch.context() as broken:
        broken.setattr(storage, "try_rename", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            add_sellers(warehouse, sellers(spark, 1, 2))
    assert warehouse.read("dim_seller").count() == 0
    assert add_sellers(warehouse, sellers(spark, 2, 3)) == 1
    assert rows(warehouse.read("dim_seller"), "seller_code") == [(1,), (2,), (3,)]
    assert storage.names(spark, f"{warehouse.root}/_pending") == []


def test_a_pending_folder_may_go_while_it_is_listed(spark, warehouse, monkeypatch):
    """Two writers that complete one commit at the same time do not trip over each other."""
    add_sellers(warehouse, sellers(spark, 1))
    assert storage.files_below(spark, f"{warehouse.root}/_pending/gone") == []
    with monkeypatch.context() as late:
        late.setattr(storage, "remove", lambda *_: None)
        add_sellers(warehouse, sellers(spark, 2))
    commit = Ledger(spark, warehouse.root, "dim_seller").last()
    Ledger(spark, warehouse.root, "dim_seller").publish(commit)
    assert rows(warehouse.read("dim_seller"), "seller_code") == [(1,), (2,)]


def test_two_writers_never_add_the_same_key(spark, warehouse):
    root, turns = warehouse.root, []
    first = sellers(spark, 1, 2).drop("seller_name")

    def slow(table):
        from tradewind.operators.joins import new_rows

        found = new_rows(first, table, ["seller_code"])
        if not turns:
            turns.append(insert_if_absent(sellers(spark, 2, 3), "dim_seller", root, ["seller_code"]))
        else:
            turns.append("again")
        return found

    assert Ledger(spark, root, "dim_seller").add(slow) == 1
    assert turns == [2, "again"]
    assert rows(warehouse.read("dim_seller"), "seller_code") == [(1,), (2,), (3,)]


def test_a_batch_is_added_once_by_its_token(spark, warehouse):
    assert add_sellers(warehouse, sellers(spark, 1), token="day-1") == 1
    assert add_sellers(warehouse, sellers(spark, 2), token="day-1") == 0
    assert add_sellers(warehouse, sellers(spark, 2), token="day-2") == 1
    assert add_sellers(warehouse, sellers(spark, 2), token="day-3") == 0
    assert Ledger(spark, warehouse.root, "dim_seller").has("day-3")


def test_the_number_of_a_lost_writer_is_passed_over(spark, warehouse, monkeypatch):
    add_sellers(warehouse, sellers(spark, 1))
    storage.create_new(spark, f"{warehouse.root}/_commits/dim_seller/{2:012d}", "")
    monkeypatch.setattr(storage, "PATIENCE", 1)
    assert add_sellers(warehouse, sellers(spark, 2)) == 1
    assert Ledger(spark, warehouse.root, "dim_seller").last().number == 3
    assert rows(warehouse.read("dim_seller"), "seller_id") == [(1,), (2,)]


def test_landed_files_are_listed_once(spark):
    root = scratch_path(spark, "manifest")
    batch = lambda day, *names: rows_to_df(spark, [(n, day) for n in names], "name string, day string")
    assert files.land_if_absent(batch("1", "a", "b", "b"), root, "1") == 2
    assert files.land_if_absent(batch("1", "a", "b", "c"), root, "1") == 0
    assert files.land_if_absent(batch("2", "b", "c"), root) == 1
    assert rows(read_table(spark, "landed", root)) == [("a", "1"), ("b", "1"), ("c", "2")]
    assert files.land_if_absent(batch("3"), root, "3") == 0


# ---- versions ----


def named(spark, *names):
    return rows_to_df(spark, [(k, n) for k, n in enumerate(names)], "location_id bigint, location_name string")


def test_a_swap_that_stops_between_its_steps_leaves_a_whole_table(spark, monkeypatch):
    root = scratch_path(spark, "swap")
    tables.append_table(named(spark, "a", "b"), "dim_location", root)
    with monkeypatch.context() as broken:
        broken.setattr(storage, "create_numbered", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.swap_table(named(spark, "x"), "dim_location", root)
    assert rows(read_table(spark, "dim_location", root), "location_name") == [("a",), ("b",)]
    before = read_table(spark, "dim_location", root)
    assert tables.swap_table(named(spark, "c"), "dim_location", root)
    assert rows(before, "location_name") == [("a",), ("b",)]
    assert rows(read_table(spark, "dim_location", root), "location_name") == [("c",)]
    tables.append_table(named(spark, "d"), "dim_location", root)
    assert rows(read_table(spark, "dim_location", root), "location_name") == [("c",), ("d",)]
    for name in ("e", "f"):
        tables.swap_table(named(spark, name), "dim_location", root)
    assert rows(read_table(spark, "dim_location", root), "location_name") == [("f",)]
    assert len(storage.glob(spark, f"{root}/_versions/dim_location-*")) == 2


def test_the_second_of_two_swaps_from_one_version_is_refused(spark):
    root = scratch_path(spark, "swap")
    tables.append_table(named(spark, "a"), "dim_location", root)
    start = tables.pointer(spark, "dim_location", root)
    assert tables.swap_table(named(spark, "b"), "dim_location", root, start)
    assert not tables.swap_table(named(spark, "c"), "dim_location", root, start)
    assert rows(read_table(spark, "dim_location", root), "location_name") == [("b",)]


# ---- latest rows and buckets ----


def load(spark, sf, warehouse, *days):
    tree = star.stored(spark, sf, "category_tree").where("platform_id = 12")
    for date_id in days:
        step = incremental.run_initial if date_id == days[0] else incremental.run_incremental
        step(warehouse, fixture.landing(spark, sf, 12, date_id), 12, DAYS[date_id], tree)
    return warehouse


@pytest.fixture(scope="module")
def plain(spark, sf):
    return load(spark, sf, Warehouse(spark, scratch_path(spark, "plain")).create(), 4, 5, 6)


@pytest.fixture(scope="module")
def bucketed(spark, sf):
    return load(spark, sf, Warehouse(spark, scratch_path(spark, "bucketed")).create(buckets=4), 4, 5, 6)


@pytest.mark.parametrize("fact", list(LATEST))
def test_kept_rows_are_the_latest_rows(plain, bucketed, fact):
    expected = rows(latest_rows(plain.read(fact), PRODUCT_KEY))
    assert expected and rows(latest_facts(plain, fact).select(*plain.read(fact).columns)) == expected
    assert len(rows(latest_facts(bucketed, fact))) == len(expected)


def test_a_fold_that_was_missed_is_made_up_for(spark, sf, monkeypatch):
    warehouse = load(spark, sf, Warehouse(spark, scratch_path(spark, "fold")).create(), 5)
    before = latest_facts(warehouse, "fact_sales").count()
    fact = warehouse.read("fact_sales")
    more = fact.limit(3).withColumn("date_id", F.col("date_id") + 1).drop("sale_id")
    warehouse.add("fact_sales", lambda _: more, 12, id_col="sale_id", keys=incremental.SALE_KEYS)
    assert latest_facts(warehouse, "fact_sales").count() == before
    assert latest_facts(warehouse, "fact_sales").where("date_id = 2").count() == 0
    fold_latest(warehouse, "fact_sales", 12)
    assert latest_facts(warehouse, "fact_sales").where("date_id = 2").count() == 3
    assert rows(latest_facts(warehouse, "fact_sales").select("sale_id")) == rows(latest_rows(warehouse.read("fact_sales"), PRODUCT_KEY), "sale_id")


def test_reports_do_not_read_the_history(plain):
    held = plain.tables()
    for report, fact in ((reports.growth_report, "fact_periodic_sales"), (reports.sales_report, "fact_sales")):
        text = report(held, platform_id=12)._jdf.queryExecution().executedPlan().toString()
        assert f"/{fact}" not in text and LATEST[fact][0] in text
    without = {name: frame for name, frame in held.items() if name in ("fact_sales", "fact_periodic_sales") or name.startswith("dim_")}
    assert rows(reports.sales_report(held, platform_id=12)) == rows(reports.sales_report(without, platform_id=12))
    assert rows(reports.growth_report(held, period="60-DAY")) == rows(reports.growth_report(without, period="60-DAY"))


def test_bucketed_facts_are_those_of_a_plain_warehouse(plain, bucketed):
    for name, measures in (("fact_sales", ["date_id", "units_sold"]), ("fact_periodic_sales", ["report_period", "units_sold"])):
        columns = [*PRODUCT_KEY, *measures, "total_sales_amount"]
        assert rows(bucketed.read(name), *columns) == rows(plain.read(name), *columns)


def test_a_history_in_buckets_is_not_shuffled(spark, plain, bucketed):
    fact = bucketed.read("fact_sales")
    image = plain.read("fact_sales").where("date_id = 3")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        import tradewind.operators.skew as skew

        keep, skew.fits_broadcast = skew.fits_broadcast, lambda *_: False
        with colocated(spark):
            text = new_facts(image, fact.where("platform_id = 12"), FACT_KEYS[12], unique=True)._jdf.queryExecution().executedPlan().toString()
        skew.fits_broadcast = keep
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = text.splitlines()
    join = next(k for k, line in enumerate(lines) if "LeftAnti" in line)
    indent = next(line for line in lines[join + 1 :] if ":- " in line).index(":- ")
    second = next(k for k in range(join + 1, len(lines)) if lines[k][indent:].startswith("+- "))
    image_side, history_side = "\n".join(lines[join + 1 : second]), "\n".join(lines[second:])
    assert "Exchange hashpartitioning" in image_side
    assert "Bucketed: true" in history_side and "Exchange" not in history_side


def test_a_page_takes_one_run_of_its_report(spark, plain):
    """A report that may run once only still gives its page; so does the pivot."""
    from tradewind.operators import rollups

    report = reports.sales_report(plain.tables(), platform_id=12)
    expected = rows(reports.best_seller_page(report, page=2))
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches

    once = report.coalesce(1).mapInArrow(counted, report.schema)
    assert rows(reports.best_seller_page(once, page=2)) == expected and len(expected) == 10
    assert runs.value == 1
    growth = reports.growth_report(plain.tables(), period="60-DAY")
    pivot = rows(rollups.band_pivot(growth))
    before = runs.value
    assert rows(rollups.band_pivot(growth.coalesce(1).mapInArrow(counted, growth.schema))) == pivot
    assert runs.value == before + 1
