"""The daily partition job: create what is needed, then drop what is due."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewire.functions.months import retention_cutoff
from gatewire.operators import partitions as p
from gatewire.sources.catalog import update_catalog
from gatewire.sources.tables import drop_months, drop_refused, stored_months
from gatewire.vocabulary import SCHEMA_NAMES


def due_for_drop(catalog: DataFrame, as_of: dt.date, retention_months: int, unbounded: bool = False) -> DataFrame:
    """What retention asks to drop; with ``unbounded`` also what lies beyond the look-back."""
    if unbounded:
        return p.expired_partitions(catalog, as_of, retention_months)
    return p.partitions_to_drop(p.on_day(catalog.sparkSession, as_of), F.lit(retention_months))


def maintain(
    catalog: DataFrame,
    as_of: dt.date,
    enabled: bool = False,
    retention_months: int = 1,
    unbounded: bool = False,
) -> DataFrame:
    """The partition list after a run on day ``as_of``. Dropping is off unless asked for."""
    wanted = p.plan_partitions(p.on_day(catalog.sparkSession, as_of))
    created = p.create_missing(catalog, wanted)
    if not enabled:
        return created
    return p.drop_listed(created, due_for_drop(created, as_of, retention_months, unbounded))


def run_maintenance(
    spark: SparkSession,
    catalog_root: str,
    table_paths: dict[str, str],
    as_of: dt.date,
    enabled: bool = False,
    retention_months: int = 1,
    unbounded: bool = False,
    refused: list[str] | None = None,
    refused_months: int | None = None,
) -> list[str]:
    """Bring list and tables (``authn`` / ``authz`` -> path) up to date; returns the deleted folders.

    The new list is in force before any folder goes, so no row is accepted into
    a month that is about to vanish.  What to delete follows from the day and
    the folders, not from the list, so a run that dies in between is finished
    by the next one.  Runs side by side keep each other's partitions.

    Refused messages have a time axis of their own, that of their arrival: below the
    roots in ``refused`` those that came more than ``refused_months`` months before go, however old;
    without that number all stay.
    """
    update_catalog(spark, catalog_root, lambda present: maintain(present, as_of, enabled, retention_months, unbounded))
    if not enabled:
        return []
    # At most 24 months for two schemas.
    due = p.partitions_to_drop(p.on_day(spark, as_of), F.lit(retention_months)).collect()
    cutoff = p.on_day(spark, as_of).select(retention_cutoff(F.col("as_of"), retention_months)).first()[0]
    deleted = []
    for kind, path in table_paths.items():
        if unbounded:
            months = [month for month in stored_months(spark, path) if month < cutoff]
        else:
            months = [row.start_date for row in due if row.schema_name == SCHEMA_NAMES[kind]]
        deleted += drop_months(spark, path, months)
    if refused_months is not None:
        oldest = p.on_day(spark, as_of).select(retention_cutoff(F.col("as_of"), refused_months)).first()[0]
        for root in refused or []:
            deleted += drop_refused(spark, root, oldest)
    return deleted
