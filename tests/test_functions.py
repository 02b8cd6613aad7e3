"""Text, value and date rules on edge rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradewind import functions as X
from tradewind.operators.rollups import band_number


def evaluate(spark, cases, schema, expression):
    """Apply an expression to every input and return the outputs in order."""
    numbered = [(i, *case) for i, case in enumerate(cases)]
    df = spark.createDataFrame(numbered, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression.alias("out")).collect()]


def texts(spark, inputs, expression):
    return evaluate(spark, [(t,) for t in inputs], "c string", expression)


def test_sold_count(spark):
    cases = {
        None: 0,
        "": 0,
        "abc": 0,
        "120": 120,
        "3k": 3000,
        "1,2k": 1200,
        "1.2K sold": 1200,
        "1.25k": 12500,
        "3,k": 300,
        "250 stock": 250000,
        "1.234": 1234,
    }
    assert texts(spark, cases, X.sold_count(F.col("c"))) == list(cases.values())


def test_sold_count_out_of_range_is_null(spark):
    assert texts(spark, ["9999999999999999999k", "9000000000000000000k"], X.sold_count(F.col("c"))) == [None, None]


def test_discount_rate(spark):
    cases = {"35% Off": "0.35", "5% Off": "0.05", "": None, None: None, "abc": None}
    expected = [None if v is None else Decimal(v) for v in cases.values()]
    assert texts(spark, cases, X.discount_rate(F.col("c"))) == expected


def test_clean_location(spark):
    cases = {
        "TP. Hồ Chí Minh": "HỒ CHÍ MINH",
        "Bà Rịa - Vũng Tàu": "BÀ RỊA VŨNG TÀU",
        "|Hà Nội": "HÀ NỘI",
        " Huế\t": "HUẾ",
        "": None,
        None: None,
    }
    assert texts(spark, cases, F.upper(X.clean_location(F.col("c")))) == list(cases.values())


def test_product_id_from_url(spark):
    cases = {"https://x/a-i.123.456?sp=1": "456", "https://x/a-i.123.456": None, "": None, None: None}
    assert texts(spark, cases, X.product_id_from_url(F.col("c"))) == list(cases.values())


def test_prices(spark):
    c = F.col("c")
    assert texts(spark, ["1.234.000", "10.000 - 20.000", "", None], X.money(X.clean_price(c, "."))) == [
        Decimal("1234000.00"),
        Decimal("0.00"),
        Decimal("0.00"),
        Decimal("0.00"),
    ]
    assert texts(spark, ["₫1.500.000"], X.money(X.clean_price(c, "₫."))) == [Decimal("1500000.00")]
    assert texts(spark, ["-35%", ""], X.percent_rate(X.clean_price(c, "-%"))) == [Decimal("0.35"), Decimal("0.00")]


def test_money_stays_decimal(spark):
    df = spark.range(1).select(X.money(F.lit("1.5")).alias("m"), X.rate(F.lit(None)).alias("r"))
    assert dict(df.dtypes) == {"m": "decimal(15,2)", "r": "decimal(5,2)"}


def test_period_label(spark):
    days = [0, 7, 8, 14, 15, 21, 22, 30, 31, 400]
    expected = ["7-DAY"] * 2 + ["14-DAY"] * 2 + ["21-DAY"] * 2 + ["30-DAY"] * 2 + ["60-DAY"] * 2
    assert evaluate(spark, [(d,) for d in days], "d int", X.period_label(F.col("d"))) == expected


def test_period_start(spark):
    out = evaluate(
        spark, [(dt.date(2024, 7, 31), "30-DAY")], "d date, p string", X.period_start(F.col("d"), F.col("p"))
    )
    assert out == [dt.date(2024, 7, 1)]


@pytest.mark.parametrize(
    ("new", "previous", "expected"),
    [
        ((150, "1800"), None, "1800.00"),
        ((150, "1800"), (100, "1000"), "1600.00"),
        ((80, "960"), (100, "1000"), "760.00"),
        ((0, "0"), (100, "1000"), "0.00"),
    ],
)
def test_adjusted_amount(spark, new, previous, expected):
    prev = previous or (None, None)
    row = (new[0], Decimal(new[1]), prev[0], None if prev[1] is None else Decimal(prev[1]), previous is not None)
    schema = "nu bigint, na decimal(38,2), pu bigint, pa decimal(38,2), has boolean"
    value = X.adjusted_amount(F.col("nu"), F.col("na"), F.col("pu"), F.col("pa"), F.col("has"))
    assert evaluate(spark, [row], schema, value) == [Decimal(expected)]


def test_price_band(spark):
    prices = ["0", "9999.99", "10000", "2999999.99", "3000000", "-1"]
    out = evaluate(spark, [(Decimal(p),) for p in prices], "p decimal(15,2)", band_number(F.col("p")))
    assert out == [1, 1, 2, 7, 8, None]


def test_links(spark):
    assert texts(spark, ["thoi-trang-nu/c2"], X.link_id(F.col("c"))) == ["2"]
    assert texts(spark, ["thoi-trang-nu/c2", "c2"], X.link_key(F.col("c"))) == ["thoi-trang-nu", None]
    assert texts(spark, ["https://x/A/Ao-Dai "], X.url_tail(F.col("c"))) == ["ao-dai"]
    assert texts(spark, ["/cat.1.22"], X.id_tail(F.col("c"))) == ["22"]


def test_csv_items_are_trimmed(spark):
    assert texts(spark, ["a, B ,,c", ""], X.csv_items(F.col("c"))) == [["a", "B", "", "c"], []]


def test_contains_treats_marks_like_sql(spark):
    cases = [("xyz", "x_z"), ("xbx", "B"), ("a_b", r"a\_b"), ("axb", r"a\_b"), ("a1b", r"\a1"), ("100%", "0%")]
    out = evaluate(spark, cases, "c string, k string", X.contains_ci(F.col("c"), F.col("k")))
    assert out == [True, True, True, False, True, True]


def test_grouped(spark):
    assert evaluate(spark, [(1234567,)], "n bigint", X.grouped(F.col("n"))) == ["1,234,567"]


def test_sql_functions_agree(spark):
    X.register_functions(spark)
    samples = ["1.2k sold", "35% Off", "TP. Huế", "x-i.1.2?y", "", None, "3,k", "250 stock"]
    df = spark.createDataFrame([(s,) for s in samples], "c string")
    same = df.select(
        (F.expr("sold_count(c)").eqNullSafe(X.sold_count(F.col("c")))).alias("a"),
        (F.expr("discount_rate(c)").eqNullSafe(X.discount_rate(F.col("c")))).alias("b"),
        (F.expr("clean_location(c)").eqNullSafe(X.clean_location(F.col("c")))).alias("d"),
        (F.expr("product_id_from_url(c)").eqNullSafe(X.product_id_from_url(F.col("c")))).alias("e"),
    )
    assert all(all(r) for r in same.collect())
