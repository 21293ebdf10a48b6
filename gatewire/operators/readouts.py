"""Reading stored events back: time ranges, partition statistics, request attributes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from gatewire.functions.months import month_start
from gatewire.schemas import CONTEXT_REQUEST_DDL
from gatewire.vocabulary import SCHEMA_NAMES


def time_range(events: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Events with ``start <= created < end`` of a table partitioned by ``created_month``.

    A condition on the timestamp alone prunes no folder, so the months are
    asked for as well; the timestamp condition goes to the Parquet reader.
    """
    last = end - dt.timedelta(microseconds=1)
    months = F.col("created_month").between(start.date().replace(day=1), last.date().replace(day=1))
    # As text, so that Python's own time zone has no say in it.
    since, until = F.lit(start.isoformat()), F.lit(end.isoformat())
    return events.where(months & (F.col("created") >= since) & (F.col("created") < until))


def with_month(events: DataFrame) -> DataFrame:
    return events.withColumn("created_month", month_start(F.col("created")))


def with_partition(events: DataFrame, kind: str) -> DataFrame:
    """Events of one kind with the schema and month of the partition they lie in."""
    return with_month(events).withColumn("schema_name", F.lit(SCHEMA_NAMES[kind]))


def partition_stats(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Row count, first and last event per listed partition; empty ones show 0.

    ``events`` has ``schema_name, created_month, created``, of both kinds together
    (see ``with_partition``).  Counting happens before the shuffle, so a month holding most of the rows
    costs no more than any other.
    """
    found = events.groupBy("schema_name", "created_month").agg(
        F.count("*").alias("n_rows"),
        F.min("created").alias("first_created"),
        F.max("created").alias("last_created"),
    )
    return listed_stats(found, catalog)


def listed_stats(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Statistics that there are, by ``schema_name`` and ``created_month``, for each listed partition; others show 0."""
    known = found.withColumnRenamed("created_month", "start_date")
    return (
        catalog.join(known, ["schema_name", "start_date"], "left")
        .select(*catalog.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_created", "last_created")
    )


def flatten_context(events: DataFrame, keep: tuple[str, ...], context: str = "contextrequestjson") -> DataFrame:
    """One row per category, attribute and value of the stored access request.

    A category without attributes, or an attribute without values, still gives
    one row.
    """
    rows = events.select(*keep, request_attributes(context).alias("_attributes"))
    return flatten_attributes(rows, keep, "_attributes")


def request_attributes(context: str) -> Column:
    """The categories of a stored access request; NULL if it isn't one."""
    return F.try_variant_get(F.col(context), "$", CONTEXT_REQUEST_DDL)["Attributes"]


def flatten_attributes(events: DataFrame, keep: tuple[str, ...], attributes: str) -> DataFrame:
    """One row per category, attribute and value of a typed column."""
    return (
        events.select(*keep, F.explode_outer(attributes).alias("_category"))
        .select(
            *keep,
            F.col("_category.Category").alias("category"),
            F.explode_outer("_category.Attributes").alias("_attribute"),
        )
        .select(
            *keep,
            "category",
            F.col("_attribute.AttributeId").alias("attribute_id"),
            F.col("_attribute.Issuer").alias("issuer"),
            F.col("_attribute.IncludeInResult").alias("include_in_result"),
            F.explode_outer("_attribute.AttributeValues").alias("_value"),
        )
        .select(
            *keep,
            "category",
            "attribute_id",
            "issuer",
            "include_in_result",
            F.col("_value.Value").alias("value"),
            F.col("_value.DataType").alias("data_type"),
        )
    )


def union_generations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events of the first and the present table generation as one bag; columns the old lacks are NULL."""
    return new.unionByName(old, allowMissingColumns=True)
