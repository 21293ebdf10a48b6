"""Calendar arithmetic for monthly partitions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gatewire.vocabulary import PARTITION_NAME_PATTERN


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_end(day: Column) -> Column:
    """First day of the following month; the range is half-open."""
    return F.add_months(month_start(day), 1)


def partition_name(day: Column) -> Column:
    return F.date_format(day, PARTITION_NAME_PATTERN)


def retention_cutoff(as_of: Column, retention_months: Column | int) -> Column:
    """First day of the month lying ``retention_months`` before the month of ``as_of``."""
    months = F.lit(retention_months) if isinstance(retention_months, int) else retention_months
    return F.add_months(month_start(as_of), -months)
