"""Registered queries: name, survey rows covered, Spark callable, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function name."""

    def register(run: Run) -> Run:
        name = run.__name__
        if name in CHECKS:
            raise ValueError(f"query {name} is registered twice")
        CHECKS[name] = Check(name, tuple(covers.split()), run, sql)
        return run

    return register
