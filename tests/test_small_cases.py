"""Small cases with known results: dimensions, trees, rollups, pages, batches."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tradewind.operators import cleaning, filters, joins, rollups, scd, trees
from tradewind.operators.cleaning import PRODUCT_ROWS
from tradewind.plans import dimensions, reports
from tradewind.plans.warehouse import Warehouse, staging
from tradewind.schemas import LANDING, P10, P12, PLATFORMS, PRODUCT_KEY, TABLES, TREE_ROW
from tradewind.session import scratch_path
from tradewind.sources import landing, payloads, requests
from tradewind.sources.tables import rows_to_df

GARDEN = [
    {
        "category_id": "810",
        "category_name": "Vườn & sân",
        "category_urlKey": "garden",
        "children": [
            {"category_id": 820, "category_name": "Tools", "children": [{"category_id": "821", "category_name": "Spades", "category_urlKey": ""}]},
            {"category_id": "none", "category_name": "Lost", "children": [{"category_id": "822", "category_name": "Lost too"}]},
            {"category_id": "830", "category_name": "Seeds", "category_urlKey": "seeds", "children": []},
        ],
    },
    {"category_id": "900", "category_name": None, "category_urlKey": "odds"},
]
GARDEN_ROWS = [
    (810, 12, "Vườn & sân", "garden", -1, 0),
    (820, 12, "Tools", "", 810, 1),
    (821, 12, "Spades", "", 820, 2),
    (830, 12, "Seeds", "seeds", 810, 1),
    (900, 12, None, "odds", -1, 0),
]


def report(spark, entries):
    """Report rows from (date, sold, amount, code, platform, seller, price) parts, the rest filled in."""
    schema = """updated_date date, sold bigint, amount decimal(38,2), product_code string, platform_id int,
        platform_name string, seller_id bigint, seller_name string, category_id bigint, category_name string,
        brand_id bigint, brand_name string, location_id bigint, location_name string, product_price decimal(15,2)"""
    out = []
    for e in entries:
        n = e.get("n", 1)
        out.append(
            (
                e.get("date"),
                e.get("sold", 0),
                Decimal(e.get("amount", 0)),
                e.get("code", "P"),
                e.get("platform", n),
                f"Platform{e.get('platform', n)}",
                e.get("seller", n),
                f"X{n}",
                n,
                f"X{n}",
                n,
                f"X{n}",
                n,
                f"X{n}",
                Decimal(e.get("price", 0)),
            )
        )
    return spark.createDataFrame(out, schema)


def test_tree_rows(spark):
    """Null, empty, cut off and foreign bodies give no rows; nodes without a number go with all below them."""
    texts = [json.dumps(GARDEN), None, "", "[{", "{}", "7", "[]", '"text"', "[1, null, [2]]"]
    tree = trees.flatten_tree(spark.createDataFrame([(t,) for t in texts], "body string"), "body", P12)
    assert tree.schema.simpleString() == spark.createDataFrame([], TREE_ROW).schema.simpleString()
    assert rows(tree) == sorted(GARDEN_ROWS)
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_trees_deeper_than_one_round(spark):
    deep = {"category_id": "40", "category_name": "n40"}
    for code in range(39, -1, -1):
        deep = {"category_id": str(code), "category_name": f"n{code}", "children": [deep]}
    tree = trees.flatten_tree(spark.createDataFrame([(json.dumps([deep]),)], "body string"), "body", P12)
    assert rows(tree, "category_code", "parent_code", "level") == sorted(((k, k - 1, k) for k in range(41)), key=lambda r: tuple(map(str, r)))


def test_categories_in_one_append_with_parent_ids(spark):
    warehouse = Warehouse(spark, scratch_path(spark, "cats")).create()
    bodies = spark.createDataFrame([(json.dumps(GARDEN),)], "body string")
    with staging(spark) as stage:
        dimensions.load_categories(warehouse, trees.flatten_tree(bodies, "body", P12), stage)
        dimensions.load_categories(warehouse, trees.flatten_tree(bodies, "body", P12), stage)
    found = {r["category_code"]: r for r in warehouse.read("dim_category").collect()}
    assert set(found) == {code for code, *_ in GARDEN_ROWS}
    ids = {code: found[code]["category_id"] for code in found} | {-1: None}
    assert {code: found[code]["parent_id"] for code in found} == {code: ids[parent] for code, _, _, _, parent, _ in GARDEN_ROWS}


@pytest.fixture(scope="module")
def p12(spark):
    """A brand under two spellings, a padded one, items without brand or seller, and a seller without a link."""
    data = "struct<brand: struct<id: bigint, name: string>, current_seller: struct<id: bigint, name: string, link: string>>"
    offers = [
        ((700, "  Lửa Việt "), (31, "Kho Hà Nội", "kho-hn")),
        ((705, "Northwind"), (31, "Kho Hà Nội", "kho-hn")),
        (None, (44, " Chợ Đêm", None)),
        ((705, "Northwind"), None),
        ((None, "Nameless"), (None, "Nobody", "x")),
    ]
    return spark.createDataFrame([((brand, seller),) for brand, seller in offers], f"data {data}")


def test_brand_rows(p12):
    assert rows(cleaning.brand_rows(p12, P12)) == [(700, "Lửa Việt", 12), (705, "Northwind", 12)]


def test_seller_rows(p12):
    found = cleaning.seller_rows(p12, P12).select("seller_code", "seller_url", "platform_id")
    assert rows(found) == [(31, "kho-hn", 12), (44, None, 12)]


def test_only_unknown_brands_are_new(spark, p12):
    table = spark.createDataFrame([(700, 11), (705, 12)], "brand_code bigint, platform_id int")
    image = cleaning.brand_rows(p12, P12)
    assert rows(joins.new_rows(image, table, ["brand_code", "platform_id"])) == [(700, "Lửa Việt", 12)]


def test_seeds_are_added_once(spark):
    warehouse = Warehouse(spark, scratch_path(spark, "seeds")).create()
    for _ in range(2):
        dimensions.seed(warehouse, "2024-07-21")
    assert rows(warehouse.read("dim_date")) == [(1, dt.date(2024, 7, 21), 21, 7, 2024, 3)]
    assert rows(warehouse.read("dim_platform")) == sorted(PLATFORMS.items())
    for name in ("dim_brand", "dim_seller", "dim_category"):
        assert warehouse.read(name).count() == 3
    assert rows(warehouse.read("dim_location")) == [(-1, "Chưa rõ")]
    dimensions.seed(warehouse, "2024-07-22")
    assert rows(warehouse.read("dim_date"), "date_id") == [(1,), (2,)]


def _land(spark, folder, names):
    for i, name in enumerate(names):
        spark.createDataFrame([(str(i),)], "product_id string").coalesce(1).write.json(f"{folder}/tmp{i}")
    from tradewind.sources import storage

    for i, name in enumerate(names):
        part = storage.glob(spark, f"{folder}/tmp{i}/part-*")[0]
        storage.rename(spark, part, f"{folder}/{name}")
        storage.remove(spark, f"{folder}/tmp{i}")


def test_latest_batch_takes_all_files_of_its_date(spark):
    folder = scratch_path(spark, "batches")
    _land(spark, folder, ["list-2024-07-10-1.json", "details-2024-06-11-1.json", "details-2024-06-12-1.json", "details-2024-06-12-2.json"])
    batch, day = landing.latest_batch(spark, folder, "details", "product_id string")
    assert day == dt.date(2024, 6, 12)
    assert rows(batch) == [("2",), ("3",)]
    assert landing.latest_file(spark, folder, "list").first()["name"] == "list-2024-07-10-1.json"
    assert landing.latest_batch(spark, folder, "other", "product_id string") == (None, None)


def test_file_without_date_is_an_error(spark):
    folder = scratch_path(spark, "undated")
    _land(spark, folder, ["details-today.json"])
    with pytest.raises(ValueError, match="date token"):
        landing.latest_batch(spark, folder, "details", "product_id string")


def test_leaves(spark):
    nodes = [(5, 12, "Kitchen", "", -1, 0), (6, 12, "Bath", "", -1, 0), (7, 12, "Towels", "", 6, 1), (7, 11, "Towels", "", 5, 1)]
    tree = spark.createDataFrame(nodes, TREE_ROW)
    assert rows(trees.leaves(tree), "category_code", "platform_id") == [(5, 12), (7, 11), (7, 12)]
    assert rows(trees.leaves_under(tree, ["kitchen", "bath"], ["towels"]), "category_code") == [(5,), (7,)]
    assert rows(trees.leaves_under(tree, ["bath"], ["soap"]), "category_code") == []


def test_sub_category_payload(spark):
    """Nested pages of any depth; bodies that are null, cut off or no page give no record."""
    page = {"data": [{"id": 61, "name": 'Nồi "inox"', "url_key": "noi", "children": [{"id": "62", "name": "tab\t", "url_key": None, "children": []}]}, {"id": 63, "name": "Chảo", "url_key": "chao"}]}
    level = {"id": 9, "name": "end", "url_key": "e"}
    for number in range(8, -1, -1):
        level = {"id": number, "name": f"l{number}", "url_key": "k", "children": [level]}
    texts = [json.dumps(page), None, "", "{", "[]", '{"other": 1}', json.dumps({"data": []}), json.dumps({"data": [level]})]
    df = spark.createDataFrame([(str(k), f"n{k}", "key", t) for k, t in enumerate(texts)], "i string, n string, k string, body string")
    found = payloads.normalize_payload(df, "body", "category", parent=("i", "n", "k"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    records = {r.category_id: json.loads(r.record) for r in found.collect()}

    def record(code, name, key, children):
        below = [record(str(c["id"]), c["name"], c["url_key"], c.get("children") or []) for c in children]
        return {"category_id": code, "category_name": name, "category_urlKey": key} | ({"children": below} if below else {})

    assert records == {str(k): record(str(k), f"n{k}", "key", json.loads(texts[k])["data"]) for k in (0, 6, 7)}
    with pytest.raises(ValueError, match="parent"):
        payloads.normalize_payload(df, "body", "category")


def test_detail_payload(spark):
    bodies = ['{"id":"77","categories":{"id":"5005"}}', '{"id":78,"categories":null}', '{"id":null}', "{}", "x", None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    found = payloads.normalize_payload(df, "body", "detail", F.lit("0"))
    assert rows(found, "product_id", "category_id") == [("77", "5005"), ("78", "")]


def test_page_urls(spark):
    df = spark.createDataFrame([(4, "hats", 2), (5, "gloves", 0), (6, "socks", None)], "c int, k string, n int")
    found = requests.expand_last_page(df, "n", "list?cat=%d&name=%s&p=%d", ["c", "k"])
    assert rows(found, "page_url") == [("list?cat=4&name=hats&p=1",), ("list?cat=4&name=hats&p=2",)]
    ids = spark.createDataFrame([(9, 90)], "p int, s int")
    assert rows(requests.detail_urls(ids, "item/%d/from/%d", ["p", "s"]), "url") == [("item/9/from/90",)]


def test_summary(spark):
    full = report(
        spark,
        [
            {"date": dt.date(2021, 2, 28), "sold": 7, "amount": 90, "code": "a", "n": 4},
            {"date": dt.date(2021, 3, 1), "sold": 11, "amount": 0, "code": "a", "n": 4},
            {"date": None, "sold": 1, "amount": 5, "code": "b", "n": 9},
        ],
    )
    assert tuple(rollups.summary(full).first()) == (dt.date(2021, 3, 1), 19, Decimal("95.00"), 2, 2)
    assert tuple(rollups.summary(report(spark, [])).first()) == (None, 0, Decimal("0.00"), 0, 0)


@pytest.mark.parametrize("chart", [rollups.top_categories, rollups.top_sellers, rollups.top_brands, rollups.top_locations])
def test_charts(spark, chart):
    """Units and amounts put the groups in opposite orders."""
    entries = [{"n": 3, "sold": 4, "amount": 70}, {"n": 8, "sold": 9, "amount": 20}, {"n": 3, "sold": 4, "amount": 30}]
    full = report(spark, entries)
    assert [tuple(r) for r in chart(full, rollups.SALES).collect()] == [("X8", 9), ("X3", 8)]
    assert [tuple(r) for r in chart(full, rollups.REVENUE).collect()] == [("X3", 100), ("X8", 20)]
    assert chart(report(spark, []), rollups.SALES).count() == 0


def test_platform_chart(spark):
    full = report(spark, [{"n": 5, "sold": 0}, {"n": 6, "sold": 13}, {"n": 6, "sold": 29}])
    assert rows(rollups.by_platform(full, rollups.SALES)) == [("Platform5", 0), ("Platform6", 42)]


def test_price_bands(spark):
    """Prices on both sides of a band's edge, and one that falls in no band."""
    edges = [0, 9_999, 10_000, 49_999, 50_000, 99_999, 100_000]
    full = report(spark, [{"price": p, "sold": 1, "amount": k + 1, "platform": 1} for k, p in enumerate(edges)] + [{"price": -5, "sold": 100, "amount": 1}])
    found = [(r["band"], r["total_sold"], r["platform_amounts"]) for r in rollups.price_bands(full).collect()]
    assert sum(sold for _, sold, _ in found) == len(edges)
    assert [band for band, _, _ in found] == sorted(band for band, _, _ in found)
    assert sum(amounts["Platform1"] for _, _, amounts in found) == sum(range(1, len(edges) + 1))


def test_empty_report_has_an_empty_page(spark):
    empty = report(spark, []).withColumns({"id": F.lit(1), "product_name": F.lit("x")})
    from tradewind.operators.ranking import page_info

    assert tuple(page_info(empty, 1).first()) == (0, 0, 0)


def test_keywords(spark):
    df = spark.createDataFrame([("xbx", None), ("xyz", None), (None, None)], "a string, b string")
    assert rows(filters.keyword_match(df, "q, B", ["a", "b"]), "a") == [("xbx",)]
    assert rows(filters.keyword_match(df, "q,,b", ["a", "b"]), "a") == [("xbx",), ("xyz",)]
    assert rows(filters.keyword_match(df, "x_z", ["a", "b"]), "a") == [("xyz",)]
    assert filters.keyword_match(df, None, ["a"]).count() == 3


def test_subtree_needs_a_platform(spark):
    dim = rows_to_df(spark, [(1, 1, 12, "a", "", None, 0), (2, 2, 12, "b", "", 1, 1)], TABLES["dim_category"])
    assert rows(trees.subtree(dim, 12, 1)) == [(1,), (2,)]
    assert trees.subtree(dim, None, 1).count() == 0
    assert trees.subtree(dim, 11, 1).count() == 0


def test_parameters():
    params = {"platform_id": -99, "category_id": 5, "order_by": "-99", "keywords": "  "}
    assert filters.normalize_params(params) == {"platform_id": None, "category_id": 5, "order_by": None, "keywords": None}


def test_best_sellers_need_platform_and_order():
    assert reports.best_sellers({}, {"platform_id": -99, "order_by": "sold"}) is None
    assert reports.best_sellers({}, {"platform_id": 12, "order_by": "-99"}) is None


def product(spark, entries):
    base = {
        "product_name": "n",
        "product_description": "d",
        "product_image": "i",
        "product_url": "u",
        "price": Decimal("1.00"),
        "original_price": Decimal("1.00"),
        "discount_rate": Decimal("0.00"),
        "rating_score": Decimal("0.00"),
        "review_count": 0,
        "sold": 1,
        "platform_id": 12,
        "seller_id": 1,
        "expired_date": None,
        "flag": True,
    }
    fields = [f.name for f in spark.createDataFrame([], TABLES["dim_product"]).schema.fields]
    merged = [{**base, **e} for e in entries]
    return rows_to_df(spark, [tuple(m.get(f) for f in fields) for m in merged], TABLES["dim_product"])


def test_changes_are_not_null_safe_by_default(spark):
    day = dt.date(2024, 1, 1)
    dim = product(spark, [{"product_id": 1, "product_code": "a", "effective_date": day, "product_url": None}])
    image = product(spark, [{"product_code": "a", "effective_date": day, "product_url": "u"}]).drop("product_id")
    assert joins.changed_products(image, dim).count() == 0
    assert joins.changed_products(image, dim, null_safe=True).count() == 1


def test_versions_after_two_changes(spark):
    first, second, third = (dt.date(2024, 1, d) for d in (1, 8, 15))
    dim = product(spark, [{"product_id": n, "product_code": c, "effective_date": first} for n, c in ((1, "a"), (2, "b"))])
    for day, sold in ((second, 5), (third, 9)):
        image = product(spark, [{"product_code": "a", "effective_date": day, "sold": sold}]).drop("product_id")
        dim = scd.upsert_products(dim, image, day)
    found = rows(dim, "product_id", "product_code", "sold", "effective_date", "expired_date", "flag")
    assert found == [
        (1, "a", 1, first, second, False),
        (2, "b", 1, first, None, True),
        (3, "a", 5, second, third, False),
        (4, "a", 9, third, None, True),
    ]
    assert rows(scd.product_changes(dim, image.drop("product_id"))) == []


def test_p10_belongs_to_the_unknown_seller(spark):
    df = spark.createDataFrame(
        [([("1", "A", "-1"), ("2", "B", "1")], "https://x/t-i.9.77?z", "img", "T", [], ("1.000", "₫2.000", "-50%"), "1,2k", "TP. Huế")],
        LANDING[P10],
    )
    row = PRODUCT_ROWS[P10](df, "2024-01-01").first()
    assert (row["product_code"], row["seller_code"], row["price"], row["original_price"]) == ("77", -1, Decimal(1000), Decimal(2000))
    assert (row["discount_rate"], row["sold"]) == (Decimal("0.50"), 1200)
    assert set(PRODUCT_KEY) - {"seller_id"} <= set(row.asDict())
    assert rows(cleaning.location_rows(df, P10)) == [("HUẾ",)]
    assert rows(cleaning.category_rows_nested(df), "category_code", "parent_code", "level") == [(1, -1, 0), (2, 1, 1)]
