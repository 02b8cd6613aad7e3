"""Fields of saved web pages.

Spark spreads the pages; inside a task each page becomes an element tree and every field is one path
on it. A missing field is empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree.ElementTree import Element, SubElement

import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.schemas import LANDING_P10, UNKNOWN_CODE

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSED_BY_ITSELF = {"p", "li", "tr", "td", "th", "option", "dt", "dd"}
_BATCH_ROWS = 2_000

# Where a listing page keeps its data.
ITEMS_CLASS = "row shopee-search-item-result__items"
MAIN_CATEGORY_CLASS = "shopee-category-list__main-category"
SUB_CATEGORY_CLASS = "shopee-category-list__sub-category--active"
LISTING_ITEMS = f".//ul[@class='{ITEMS_CLASS}']/li"
LISTING_MAIN_CATEGORY = f".//div[@class='{MAIN_CATEGORY_CLASS}']/a"
LISTING_FIELDS = {
    "url": ("./a", "href"),
    "image": ("./a/div/div/div[1]//img[@style='object-fit: contain']", "src"),
    "title": ("./a/div/div/div[2]/div[1]/div[1]/div", None),
    "current_price": ("./a/div/div/div[2]/div[2]/div[1]/span[3]", None),
    "original_price": ("./a/div/div/div[2]/div[2]/div[2]", None),
    "discount_rate": ("./a/div/div/div[2]/div[2]/div[3]/div/span", None),
    "sold": ("./a/div/div/div[2]/div[3]/div[2]", None),
    "location": ("./a/div/div/div[2]/div[4]/div[@aria-label='from']", None),
}
LISTING_PROMOTIONS = "./a/div/div/div[2]/div[1]/div[2]/div"
LISTING_PROMOTION_TEXT = "./div/div"


class _TreeReader(HTMLParser):
    """Element tree of a page, lenient about tags left open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("page")
        self._open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSED_BY_ITSELF and self._open[-1].tag == tag:
            self._open.pop()
        node = SubElement(self._open[-1], tag, {name: value or "" for name, value in attrs})
        if tag not in _VOID:
            self._open.append(node)

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self._open) - 1, 0, -1) if self._open[i].tag == tag), None)
        if depth is not None:
            del self._open[depth:]

    def handle_data(self, data: str) -> None:
        top = self._open[-1]
        if len(top):
            top[-1].tail = (top[-1].tail or "") + data
        else:
            top.text = (top.text or "") + data


def _tree(html: str) -> Element:
    reader = _TreeReader()
    reader.feed(html)
    reader.close()
    return reader.root


def _value(node: Element, path: str, attribute: str | None) -> str:
    found = node.find(path)
    if found is None:
        return ""
    if attribute is not None:
        return found.get(attribute, "")
    return " ".join("".join(found.itertext()).split())


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= _BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def extract_pages(
    pages: DataFrame,
    items: str,
    fields: dict[str, tuple[str, str | None]],
    key: str = "page_id",
    body: str = "html",
) -> DataFrame:
    """One row per item element of each page: page key, position from 1, and the fields.

    A field is a path below the item and, optionally, the attribute to take instead of the text.
    """
    schema = pa.schema([(key, pa.int64()), ("position", pa.int32()), *[(name, pa.string()) for name in fields]])
    declared = f"{key} bigint, position int, " + ", ".join(f"`{name}` string" for name in fields)

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for position, item in enumerate(_tree(html or "").findall(items), start=1):
                found = {name: _value(item, path, attribute) for name, (path, attribute) in fields.items()}
                yield {key: page, "position": position, **found}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _in_batches(rows(batch), schema)

    return pages.select(key, body).mapInArrow(extract, declared)


def _category(link: Element | None, parent: str) -> dict:
    if link is None:
        return {"category_id": str(UNKNOWN_CODE), "category_name": "", "parent_id": parent}
    name = " ".join("".join(link.itertext()).split())
    return {"category_id": link.get("href", "").split(".")[-1], "category_name": name, "parent_id": parent}


def _listing(html: str) -> Iterator[dict]:
    page = _tree(html)
    main = _category(page.find(LISTING_MAIN_CATEGORY), str(UNKNOWN_CODE))
    active = (a for a in page.iter("a") if SUB_CATEGORY_CLASS in a.get("class", ""))
    category = [main, _category(next(active, None), main["category_id"])]
    for item in page.findall(LISTING_ITEMS):
        found = {name: _value(item, path, attribute) for name, (path, attribute) in LISTING_FIELDS.items()}
        promotions = [
            _value(p, LISTING_PROMOTION_TEXT, None) if p.find(LISTING_PROMOTION_TEXT) is not None else _value(p, ".", None)
            for p in item.findall(LISTING_PROMOTIONS)
        ]
        price = {name: found.pop(name) for name in ("current_price", "original_price", "discount_rate")}
        yield {"category": category, "promotions": promotions, "price": price, **found}


def listing_pages(pages: DataFrame, body: str = "html") -> DataFrame:
    """Product records of saved listing pages, in the landing form of P10."""
    text = pa.string()
    schema = pa.schema(
        [
            ("category", pa.list_(pa.struct([("category_id", text), ("category_name", text), ("parent_id", text)]))),
            ("url", text),
            ("image", text),
            ("title", text),
            ("promotions", pa.list_(text)),
            ("price", pa.struct([("current_price", text), ("original_price", text), ("discount_rate", text)])),
            ("sold", text),
            ("location", text),
        ]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = (html for html in batch.column(0).to_pylist() if html)
            yield from _in_batches((row for html in bodies for row in _listing(html)), schema)

    return pages.select(body).mapInArrow(extract, LANDING_P10)
