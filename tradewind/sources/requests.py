"""Expansion of listing totals into page requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(first: Column, last: Column) -> Column:
    """Numbers from first to last; none when last is below first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def expand_pages(df: DataFrame, url: str, max_page: str) -> DataFrame:
    """One row per page 0..n-1, with 'page=0' of the url replaced."""
    pages = _counted(F.lit(0), F.col(max_page).cast("int") - 1)
    return df.select("*", F.explode(pages).alias("page")).withColumn(
        "page_url", F.replace(F.col(url), F.lit("page=0"), F.concat(F.lit("page="), F.col("page").cast("string")))
    )


def split_page_line(df: DataFrame, line: str) -> DataFrame:
    """'url,max_page' text as two columns."""
    text = F.trim(F.col(line))
    return df.select(
        "*",
        F.split_part(text, F.lit(","), F.lit(1)).alias("url"),
        F.split_part(text, F.lit(","), F.lit(2)).try_cast("int").alias("max_page"),
    )


def expand_total(df: DataFrame, total: str, size: str | int, template: str, args: list[str]) -> DataFrame:
    """One row per page 1..ceil(total/size); the template takes the args and then the page."""
    per_page = F.lit(size) if isinstance(size, int) else F.col(size)
    last = F.ceil(F.col(total) / per_page).cast("int")
    return df.select("*", F.explode(_counted(F.lit(1), last)).alias("page")).withColumn(
        "page_url", F.format_string(template, *[F.col(a) for a in args], F.col("page"))
    )


def expand_last_page(df: DataFrame, last_page: str, template: str, args: list[str]) -> DataFrame:
    """One row per page 1..last_page."""
    return expand_total(df, last_page, 1, template, args)


def detail_urls(df: DataFrame, template: str, args: list[str]) -> DataFrame:
    """Url from the ids of each row."""
    return df.withColumn("url", F.format_string(template, *[F.col(a) for a in args]))
