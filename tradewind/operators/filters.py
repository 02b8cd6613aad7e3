"""Predicates of the reports and loads."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import contains_ci
from tradewind.functions.calendar import ACCEPTED_PERIODS
from tradewind.operators.skew import join_large

# Fixed value: the number that stands for "no choice made" in a request.
NO_CHOICE = -99


def where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def where_opt(df: DataFrame, col: str, value: Any = None) -> DataFrame:
    """Equality only when a value is given, so that an unset parameter leaves no predicate behind."""
    return df if value is None else df.where(F.col(col) == value)


def any_changed(new: str, old: str, cols: list[str], null_safe: bool = False) -> Column:
    """True when any column differs between two aliases; a null side counts as unchanged by default."""

    def differs(name: str) -> Column:
        a, b = F.col(f"{new}.{name}"), F.col(f"{old}.{name}")
        return ~a.eqNullSafe(b) if null_safe else a != b

    return reduce(or_, map(differs, cols))


def positive(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(reduce(and_, [F.col(c) > 0 for c in cols]))


def period_match(df: DataFrame, period: str, col: str = "report_period") -> DataFrame:
    """Rows of a period; the 30-day choice takes the 14- and 21-day rows too."""
    return df.where(F.col(col).isin(ACCEPTED_PERIODS.get(period, [period])))


def keyword_match(df: DataFrame, keywords: str | None, cols: list[str]) -> DataFrame:
    """Rows where any comma-separated keyword occurs in any of the columns, case aside.

    An empty text holds no keyword, so no row matches; an empty item of a list matches every text.
    Each keyword is a constant pattern, so Spark reduces it to a plain substring test where it can.
    """
    if keywords is None:
        return df
    if keywords == "":
        return df.where(F.lit(False))
    words = [word.strip(" ") for word in keywords.split(",")]
    tests = [F.coalesce(contains_ci(F.col(c), F.lit(w)), F.lit(False)) for w in words for c in cols]
    return df.where(reduce(or_, tests))


def in_subtree(df: DataFrame, ids: DataFrame) -> DataFrame:
    return join_large(df, ids, ["category_id"], "left_semi").select(*df.columns)


def exists_row(df: DataFrame, predicate: Column) -> DataFrame:
    """One row that tells whether any row satisfies the predicate."""
    return df.where(predicate).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def root_categories(dim: DataFrame, platform_id: int) -> DataFrame:
    return dim.where((F.col("platform_id") == platform_id) & F.col("parent_id").isNull()).orderBy(
        F.col("category_id").desc()
    )


def normalize_params(params: Mapping[str, Any]) -> dict[str, Any]:
    """Request parameters with 'no choice' numbers and blank keywords as None."""
    clean = {name: None if value in (NO_CHOICE, str(NO_CHOICE)) else value for name, value in params.items()}
    keywords = clean.get("keywords")
    if keywords is not None and not keywords.strip():
        clean["keywords"] = None
    return clean
