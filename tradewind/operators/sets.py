"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name."""
    return reduce(DataFrame.unionByName, dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()
