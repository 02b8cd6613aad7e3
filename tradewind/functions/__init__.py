"""Column functions; all of them stay in the JVM."""

from tradewind.functions.calendar import date_parts, days_between, period_label, period_start
from tradewind.functions.registry import register_functions
from tradewind.functions.text import (
    clean_location,
    clean_price,
    contains_ci,
    csv_items,
    discount_rate,
    grouped,
    id_tail,
    item_at,
    link_id,
    link_key,
    product_id_from_url,
    sold_count,
    url_tail,
)
from tradewind.functions.values import (
    adjusted_amount,
    amount,
    count_or,
    money,
    or_default,
    percent_rate,
    rate,
    to_long,
    to_type,
    typed_lit,
)

__all__ = [
    "adjusted_amount",
    "amount",
    "clean_location",
    "clean_price",
    "contains_ci",
    "count_or",
    "csv_items",
    "date_parts",
    "days_between",
    "discount_rate",
    "grouped",
    "id_tail",
    "item_at",
    "link_id",
    "link_key",
    "money",
    "or_default",
    "percent_rate",
    "period_label",
    "period_start",
    "product_id_from_url",
    "rate",
    "register_functions",
    "sold_count",
    "to_long",
    "to_type",
    "typed_lit",
    "url_tail",
]
