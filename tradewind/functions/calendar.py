"""Dates and report periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper day bound of each growth period, shortest first; older growth is 60-DAY.
PERIOD_BOUNDS = [(7, "7-DAY"), (14, "14-DAY"), (21, "21-DAY"), (30, "30-DAY")]
LONGEST_PERIOD = "60-DAY"

# Periods offered to users, and the stored periods that each one accepts.
OFFERED_PERIODS = ["7-DAY", "30-DAY", "60-DAY"]
ACCEPTED_PERIODS = {"30-DAY": ["14-DAY", "21-DAY", "30-DAY"]}

# Preference among accepted periods; all others rank 0.
PERIOD_RANK = {"30-DAY": 3, "21-DAY": 2, "14-DAY": 1}


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def period_label(days: Column) -> Column:
    """Smallest period that holds the given number of days."""
    label = F.lit(LONGEST_PERIOD)
    for bound, name in reversed(PERIOD_BOUNDS):
        label = F.when(days <= bound, F.lit(name)).otherwise(label)
    return label


def period_rank(period: Column) -> Column:
    rank = F.lit(0)
    for name, value in PERIOD_RANK.items():
        rank = F.when(period == name, F.lit(value)).otherwise(rank)
    return rank


def date_parts(d: Column) -> list[Column]:
    """Calendar columns of the date dimension."""
    return [
        d.alias("date"),
        F.day(d).alias("day"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
    ]


def period_start(d: Column, period: Column) -> Column:
    """First day of an 'N-DAY' period that ends on the given date."""
    return F.date_sub(d, F.split_part(period, F.lit("-"), F.lit(1)).cast("int"))
