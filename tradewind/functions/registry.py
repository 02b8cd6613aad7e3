"""The text rules as SQL functions, so that SQL users get the same inlined expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "clean_location": (
        "s STRING",
        "STRING",
        r"CASE WHEN s <> '' THEN regexp_replace("
        r"replace(replace(replace(s, '|', ''), 'TP.', ''), ' - ', ' '),"
        r" r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '') END",
    ),
    "sold_count": (
        "s STRING",
        "BIGINT",
        r"CASE WHEN s IS NULL OR regexp_extract(s, r'(\d+[.,]?\d*)', 1) = '' THEN 0L"
        r" ELSE try_multiply(try_cast(regexp_replace(regexp_extract(s, r'(\d+[.,]?\d*)', 1), '[.,]', '') AS BIGINT),"
        r" CASE WHEN NOT contains(lower(s), 'k') THEN 1L"
        r" WHEN regexp_extract(s, r'(\d+[.,]?\d*)', 1) RLIKE '[.,]' THEN 100L ELSE 1000L END) END",
    ),
    "discount_rate": (
        "s STRING",
        "DECIMAL(5,2)",
        r"try_cast(try_cast(regexp_replace(replace(s, '% Off', ''), r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '')"
        r" AS DECIMAL(20,6)) / 100 AS DECIMAL(5,2))",
    ),
    "product_id_from_url": ("s STRING", "STRING", r"nullif(regexp_extract(s, r'i\.\d+\.(\d+)\?', 1), '')"),
    "period_label": (
        "days INT",
        "STRING",
        "CASE WHEN days <= 7 THEN '7-DAY' WHEN days <= 14 THEN '14-DAY' WHEN days <= 21 THEN '21-DAY'"
        " WHEN days <= 30 THEN '30-DAY' ELSE '60-DAY' END",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
