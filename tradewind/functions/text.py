"""Text rules for crawled listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.schemas import RATE

# What the crawled text looks like.
SOLD_NUMBER = r"(\d+[.,]?\d*)"
PRODUCT_URL = r"i\.\d+\.(\d+)\?"
DISCOUNT_SUFFIX = "% Off"
LOCATION_DROPPED = ["|", "TP."]
LOCATION_DASH = " - "

_OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, _OUTER_SPACE, "")


def clean_location(c: Column) -> Column:
    """Place name without list marks and city prefix; empty text is null."""
    cleaned = c
    for mark in LOCATION_DROPPED:
        cleaned = F.replace(cleaned, F.lit(mark), F.lit(""))
    cleaned = F.replace(cleaned, F.lit(LOCATION_DASH), F.lit(" "))
    return F.when(c != "", _strip(cleaned))


def sold_count(c: Column) -> Column:
    """Units from a counter such as '1.2k sold'.

    With a 'k' anywhere, a number without separator counts thousands and one with a separator
    counts hundreds once the separator is gone; without 'k' separators are only grouping.
    """
    number = F.regexp_extract(c, SOLD_NUMBER, 1)
    digits = F.regexp_replace(number, "[.,]", "").try_cast("bigint")
    in_thousands = F.lower(c).contains("k")
    factor = F.when(~in_thousands, 1).when(number.rlike("[.,]"), 100).otherwise(1000).cast("bigint")
    return F.when(c.isNull() | (number == ""), F.lit(0).cast("bigint")).otherwise(F.try_multiply(digits, factor))


def discount_rate(c: Column) -> Column:
    """'35% Off' as 0.35; null for empty or malformed text."""
    percent = _strip(F.replace(c, F.lit(DISCOUNT_SUFFIX), F.lit(""))).try_cast("decimal(20,6)")
    return (percent / F.lit(100)).try_cast(RATE)


def clean_price(c: Column, marks: str) -> Column:
    """Price or rate text without the given marks."""
    return F.translate(c, marks, "")


def product_id_from_url(c: Column) -> Column:
    """Last number of '…i.<shop>.<product>?'; null when the url has another form."""
    return F.nullif(F.regexp_extract(c, PRODUCT_URL, 1), F.lit(""))


def item_at(items: Column, position: int) -> Column:
    """Array element counted from 1; null when out of range."""
    return F.try_element_at(items, F.lit(position))


def csv_items(c: Column) -> Column:
    """Comma-separated text as an array of trimmed items."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ","), lambda item: F.trim(item)))


def contains_ci(c: Column, keyword: Column) -> Column:
    """Case-blind LIKE '%keyword%'; a backslash before an ordinary character is dropped."""
    literal = F.regexp_replace(F.lower(keyword), r"\\(?![%_\\])", "")
    return F.like(F.lower(c), F.concat(F.lit("%"), literal, F.lit("%")))


def grouped(c: Column) -> Column:
    """Number with thousands separators and no decimals."""
    return F.format_number(c, 0)


def url_tail(c: Column) -> Column:
    """Last path part, trimmed and in lower case."""
    return F.lower(F.trim(F.element_at(F.split(c, "/"), -1)))


def id_tail(c: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(c, r"\."), -1)


def link_id(c: Column) -> Column:
    """'…/key/c123' as '123'."""
    return F.trim(F.replace(F.element_at(F.split(c, "/"), -1), F.lit("c"), F.lit("")))


def link_key(c: Column) -> Column:
    """'…/key/c123' as 'key'; null when the link has one part only."""
    return F.trim(F.try_element_at(F.split(c, "/"), F.lit(-2)))
