"""Every registered query next to its oracle."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from checks.catalog import CHECKS
from checks.compare import compare


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_oracle(spark, sf, name):
    verdict, *_ = compare(spark, sf, name)
    assert verdict in ("ok", "rows only")


def test_entry_has_rows(spark):
    flagship = driver.entry(spark)
    assert flagship.columns == ["name", "value"]
    assert flagship.count() > 0


def test_driver_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
