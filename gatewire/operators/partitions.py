"""Planning monthly partitions: which should exist, which are due to go.

The day on which a job runs is always data (a column or an argument), never the
clock, so that a plan can be repeated and tested.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewire import vocabulary as v
from gatewire.functions.months import month_end, month_start, partition_name, retention_cutoff
from gatewire.schemas import CATALOG_DDL

CATALOG_KEY = ["schema_name", "name"]


def on_day(spark: SparkSession, as_of: dt.date) -> DataFrame:
    """One row with column ``as_of``."""
    return spark.range(1).select(F.lit(as_of).alias("as_of"))


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_DDL)


def describe_months(days: DataFrame, month: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Descriptor of the month around ``month`` for either schema, next to the columns in ``keep``."""
    schemas = F.array(F.lit(v.AUTHN_SCHEMA), F.lit(v.AUTHZ_SCHEMA))
    return days.select(*keep, month_start(month).alias("start_date"), F.explode(schemas).alias("schema_name")).select(
        *keep,
        "schema_name",
        partition_name(F.col("start_date")).alias("name"),
        "start_date",
        month_end(F.col("start_date")).alias("end_date"),
    )


def plan_partitions(days: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Past, current and next month of every ``as_of``, for both schemas."""
    shifted = days.withColumn("_month", F.explode(F.array(*[F.add_months("as_of", n) for n in (-1, 0, 1)])))
    return describe_months(shifted, F.col("_month"), keep)


def partitions_to_drop(days: DataFrame, retention_months: Column | int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Months that ended before the retention cutoff, at most 24 months back from ``as_of``.

    The look-back is part of the rule: a retention of 23 months or more drops
    nothing, and what is older than the look-back stays.
    """
    shifts = F.sequence(F.lit(0), F.lit(v.DROP_LOOK_BACK_MONTHS - 1))
    back = (
        days.withColumn("_cutoff", retention_cutoff(F.col("as_of"), retention_months))
        .withColumn("_back", F.explode(shifts))
        .withColumn("_month", F.add_months("as_of", -F.col("_back")))
        .where(month_end(F.col("_month")) <= F.col("_cutoff"))
    )
    return describe_months(back, F.col("_month"), keep)


def expired_partitions(catalog: DataFrame, as_of: dt.date, retention_months: int) -> DataFrame:
    """Everything in the list that ended before the cutoff, however old; the unbounded alternative."""
    return catalog.where(F.col("end_date") <= retention_cutoff(F.lit(as_of), retention_months))


def create_missing(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """The list with those partitions added that it doesn't have; running it twice changes nothing."""
    fresh = wanted.dropDuplicates(CATALOG_KEY).join(catalog, CATALOG_KEY, "left_anti")
    return catalog.unionByName(fresh.select(*catalog.columns))


def drop_listed(catalog: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The list without the given partitions; those it never had are ignored."""
    return catalog.join(unwanted.select(*CATALOG_KEY), CATALOG_KEY, "left_anti").select(*catalog.columns)


def existing(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Those of the wanted partitions that exist."""
    return wanted.join(catalog.select(*CATALOG_KEY), CATALOG_KEY, "left_semi")
